import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ticketlens.llm.lexical import LexicalPlan, build_index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    found = [(d, Counter(t), len(t)) for d, t in ((d, terms(text)) for d, text in docs) if t]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for i, words in asked.items():
        rows = []
        for d, c, n in found:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                rows.append((-score, d is None, d if d is not None else 0, d))
        out += [(i, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Élan", "日本", "THE", "the", "x-y", "a_b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([1, 2, 5, 20, 20, 20, 90, 400])))) for i in range(400)]
    docs += [(1000 + i, "w3 w3 w7 the") for i in range(90)] + [(7, "w3 w59"), (7, "w3 w59"), (None, "w3 w7"), (None, None), (2000, ""), (2001, "-- !"), (2002, "w1 " * 30_000)]
    items = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 12)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "absent"), (103, "the"), (4, "w59 w58"), (None, "w3 w9"), (104, "W3, w3; w3")]
    return docs, items


@pytest.mark.parametrize("plan", [LexicalPlan(), LexicalPlan(k=3, shard=7000, block=20), LexicalPlan(k=1, shard=20_000, growth=2), LexicalPlan(k=1000, shard=30_000)])
def test_equals_brute_force(spark, tables, plan):
    docs, items = tables
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id bigint, text string, term string, n int")
    q = spark.createDataFrame([(i, t, "c", 1) for i, t in items], "item_id int, text string, term string, w int")
    assert rows_of(search(build_index(d, plan), q, plan)) == brute(docs, items, plan.k)


def test_copies_spread(spark):
    docs = spark.createDataFrame([(None, "same text")] * 4000 + [(1, "other")], "doc_id bigint, text string")
    index = build_index(docs, LexicalPlan(shard=4000))
    sizes = [len(r.ids) for r in index.rows.filter("term IS NULL").collect()]
    assert sum(sizes) == 4001 == index.documents and max(sizes) < 1500


def test_pruning_skips_strata(spark):
    from ticketlens.llm import lexical

    docs = [(i, "rare " + "pad " * (i % 300)) for i in range(3000)]
    index = build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), LexicalPlan(k=5))
    rows = index.rows.toArrow()
    shard = lexical._Shard(rows)
    looked = []
    total = shard.strata

    class Watched:
        def __getitem__(self, at):
            looked.append(at)
            return total[at]

    shard.strata = Watched()
    top, _ = shard.best([(shard.place["rare"], 1000)], LexicalPlan(k=5))
    assert len(top) == 5 and len(looked) == 2  # the bounds, then one batch of strata


def test_other_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "key string, body string")
    items = spark.createDataFrame([("q", "one")], "name string, ask string")
    got = search(build_index(docs, doc_id="key", text="body"), items, item_id="name", text="ask").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b")]
    assert search(build_index(docs.limit(0), doc_id="key", text="body"), items, item_id="name", text="ask").collect() == []
    assert search(build_index(docs, doc_id="key", text="body"), items.limit(0), item_id="name", text="ask").collect() == []
