import hashlib
import random
from collections import Counter, defaultdict

import pytest

from ticketlens.llm.mixing import MixPlan, mix, queue

SCHEMA = "doc_id bigint, text string, source string, size string, _copies string, _copy string"


def brute(rows):
    size = {i: len((t or "").encode().split()) for i, (_, t, _) in enumerate(rows)}
    of = defaultdict(int)
    for i, (_, _, s) in enumerate(rows):
        of[s] += size[i]
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, target, live = 1.5 * sum(of.values()), {}, set(names)
    while live:
        rest = budget - sum(target.values())
        aim = {s: rest * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if aim[s] >= 2 * of[s]}
        if not over:
            target |= aim
            break
        target |= {s: 2.0 * of[s] for s in over}
        live -= over
    return size, of, target, budget


def check(spark, rows):
    got = queue(spark.createDataFrame([(*r, "1", "2", "3") for r in rows], SCHEMA)).collect()
    size, of, target, budget = brute(rows)
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in got) == Counter((d, s, size[i], of[s]) for i, (d, _, s) in enumerate(rows))
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2 and (r.size or not r.copies)
    taken = Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
    assert sum(taken.values()) <= budget
    return got, taken, target


def test_targets_are_met(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice(["a", "a", "a", "a", "b", "c", "ä", "Z", None])) for i in range(900)]
    got, taken, target = check(spark, rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 130
    again = queue(spark.createDataFrame([(*r, "1", "2", "3") for r in rows], SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_finish_order(spark):
    """The taken entries are a beginning of the order by finish time."""
    rows = [(i, "w " * (1 + i * 7 % 40), "abc"[i % 3]) for i in range(300)]
    got, _, _ = check(spark, rows)
    size, of, target, budget = brute(rows)
    entries = []
    for s in of:
        upto = 0
        for key, i in sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), i) for i, (d, _, x) in enumerate(rows) if x == s):
            upto += size[i]
            entries += [(upto / target[s], key, 0, i), ((of[s] + upto) / target[s], key, 1, i)]
    want, total = Counter(), 0
    for *_, i in sorted(entries):
        total += size[i]
        if total > budget:
            break
        want[i] += 1
    assert {r.doc_id: r.copies for r in got} == {i: want[i] for i in range(300)}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (None, "x y", "b"), (None, "x y", "b"), (4, "q " * 30_000, "c"), (5, "k", "c"), (5, "k", "c")]
    check(spark, rows)
    check(spark, [(1, None, None), (2, "", "x")])
    assert queue(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mixed_rows(spark):
    rows = [(i % 40, f"{i % 40} " * (3 + i % 5), "ab"[i % 40 % 2], "x", "y", "z") for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = Counter()
    for r in queue(docs).collect():
        wanted[r.doc_id] += r.copies
    out = mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +wanted
    assert mix(docs.limit(0)).collect() == []


def test_plan(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(100)]
    got = queue(spark.createDataFrame([(*r, "1", "2", "3") for r in rows], SCHEMA), MixPlan(weights=(1, 3), share=0.5, rounds=1)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies
    assert taken == {"a": 12, "b": 37} or taken == {"a": 13, "b": 37} or taken == {"a": 12, "b": 38}
