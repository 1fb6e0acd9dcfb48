import hashlib
import random
import zlib

import numpy as np
import pytest

from ticketlens.llm.queries import QUERIES
from ticketlens.llm.runs import RunPlan, find_runs, kept_words, periodic_runs, plant_runs, run_digests, surviving


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_runs(words, least=6, repeats=4):
    """Every period by itself: longest stretches that keep it, kept if it is their smallest period."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, repeats * q) and smallest_period(words[start:end]) == q:
                out.append((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    return (
        doc_id, len(runs), *((None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def ids(words):
    number = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 5])
def test_random_words(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(1500):
        words = []
        while len(words) < rnd.randint(0, 60):
            block = rnd.choices(range(alphabet), k=rnd.randint(1, 7))
            words += (block * rnd.randint(1, 9))[: rnd.randint(1, 50)]
        assert find_runs(ids(words)) == brute_runs(words), words


def test_other_plans():
    rnd = random.Random(9)
    for _ in range(800):
        words = rnd.choices(range(2), k=rnd.randint(0, 40))
        for least, repeats in ((2, 2), (6, 3), (9, 4), (3, 5)):
            assert find_runs(ids(words), RunPlan(least, repeats)) == brute_runs(words, least, repeats), (words, least, repeats)
    with pytest.raises(ValueError):
        RunPlan(6, 1)


def test_nested_runs():
    words = (["a"] * 6 + ["b"]) * 5 + ["x", "y"] * 5 + ["a"] * 3
    got = find_runs(ids(words))
    assert got == brute_runs(words) and (0, 35, 7) in got and (0, 6, 1) in got and (35, 10, 2) in got


def test_splitting_is_stable():
    # "r" is too rare; without it the parts make "s" too rare, and so on.
    words = ["s", "t", "s", "t", "r", "s", "t", "s", "t"] + ["u", "v"] * 4
    assert surviving(ids(words), RunPlan()) == [(9, 17)]
    assert kept_words(17, [(9, 8, 2)]).tolist() == list(range(11))


def test_long_text():
    rnd = random.Random(1)
    noise = [rnd.choice("ab") for _ in range(30_000)]
    words = noise + ["w"] * 40_000 + [f"v{i % 7001}" for i in range(50_000)]
    got = find_runs(ids(words))
    assert (30_000, 40_000, 1) in got and (70_000, 50_000, 7001) in got
    assert [r for r in got if r[0] + r[1] <= 2000] == [r for r in brute_runs(noise[:2500]) if r[0] + r[1] <= 2000]


def test_rows(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "one", "x " * 6, "x " * 5, "a b " * 4, "a b\na\x0bb " * 4, "ä\x85 " * 6, "日 本 " * 9 + "語", "a\x1ca " * 7]
    texts += [" ".join(rnd.choices(["a", "b", "é", "dd", "the"], k=rnd.randint(1, 200))) for _ in range(300)]
    rows = [(None if i == 7 else i * 37, t, "c", "r") for i, t in enumerate(texts)] + [(0, None, "c", "r"), (888, "x y " * 9, "c", "r"), (888, "x y " * 9, "c", "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words string")
    got = run_digests(periodic_runs(df.withColumn("text", plant_runs(df.doc_id, df.text)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(r[0], r[1]) for r in rows), key=repr)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[1])
    odd = spark.createDataFrame([("d-1", "x " * 9)], "key string, body string")
    assert [tuple(r.runs[0]) for r in periodic_runs(odd, doc_id="key", text="body").collect()] == [(0, 9, 1)]
    assert periodic_runs(df.limit(0)).collect() == []


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    by_id = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert len(by_id) == len(docs) and all(by_id[r.doc_id] == brute_row(r.doc_id, r.text) for r in docs if len(r.text.split()) < 1500)
