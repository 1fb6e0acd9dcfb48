import random

import pytest

from ticketlens.llm.neardup import NearDup, keep_one, near_duplicates

SCHEMA = "doc_id bigint, text string, kept string, component_id string"


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and common:
                parent[find(i)] = find(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = d if not sets[i] else min(ids) if ids else None
        out.append((d, len(sets[i]), component, component is None or d == component))
    return sorted(out, key=repr)


def corpus(seed, groups, copies, edits):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(3, 200))
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, edits)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append(" ".join(words))
    rnd.shuffle(rows)
    return [(i, t, "x", "y") for i, t in enumerate(rows)]


def answer(spark, rows, plan=NearDup()):
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), plan)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("edits", [2, 8])
def test_groups_of_near_copies(spark, edits):
    rows = corpus(edits, 12, 12, edits)
    assert answer(spark, rows) == brute(rows)
    if edits == 2:
        docs = spark.createDataFrame(rows, SCHEMA)
        kept = keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_a_large_group_spans_several_tiles(spark, monkeypatch):
    monkeypatch.setattr("ticketlens.llm.neardup.TILE", 16)
    monkeypatch.setattr("ticketlens.llm.neardup.FEW", 8)
    rows = corpus(5, 2, 120, 12)
    assert answer(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"long{i % 7000}" for i in range(60_000))
    rows = [
        (7, None, None, None), (6, "", None, None), (5, " \n\t", None, None), (None, "a b c d e f", None, None),
        (4, "A b C d e f", None, None), (4, "A b C d e f", None, None), (3, "one two", None, None), (9, "ONE  two", None, None),
        (None, "only without an id", None, None), (2, long, None, None), (1, long + " end", None, None), (8, "a b c", None, None),
    ]
    assert answer(spark, rows) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_thue_morse_words_differ(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("d-2", text), ("d-1", text), ("d-3", "other words")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {"d-1": "d-1", "d-2": "d-1", "d-3": "d-3"}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == ["d-1", "d-3"]


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    from ticketlens.llm import frames, mixing, neardup, secrets

    plans = []

    def kept(write):
        def run(df, name):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, name)
        return run

    for module in (frames, neardup):
        monkeypatch.setattr(module, "materialise", kept(module.materialise))
    monkeypatch.setattr(frames, "_BROADCAST_ROWS", -1)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "s"), (2, text + " end", "s"), (3, "token=abcdefgh more words", None)], "doc_id bigint, text string, source string")
    plans.append(("out", keep_one(docs)._jdf.queryExecution().executedPlan().toString()))
    for out in (secrets.redact(docs), mixing.mix(docs)):  # grown tables are joined last, sources before
        top = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in top and "BroadcastHashJoin" not in top
    assert {"neardup-members", "neardup-first-labels", "neardup-second"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
