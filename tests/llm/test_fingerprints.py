import hashlib
import random

import pytest

from ticketlens.llm.fingerprints import Chunker, Chunking, compare_with_next, containment, edited, fingerprints, written

SCHEMA = "doc_id bigint, text string, bucket string, fingerprint string, role string"


def slow_ends(chunker, data):
    """The same boundaries, one byte after the other."""
    plan, out, start, h = chunker.plan, [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunker.gear[b])) % (1 << 32)
        size = i + 1 - start
        bits = plan.hard_bits if size <= plan.normal else plan.easy_bits
        if size == plan.most or size >= plan.least and h < 1 << (32 - bits):
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] * (start < len(data))


@pytest.mark.parametrize("n", [0, 1, 15, 64, 5000])
def test_boundaries(n):
    data = random.Random(n).randbytes(n)
    assert Chunker().ends(data) == slow_ends(Chunker(), data)
    assert Chunker().ends(b"ab. " * n) == slow_ends(Chunker(), b"ab. " * n)


def test_shift():
    text = "".join(random.Random(1).choices("abcdefgh ", k=20_000))
    c = Chunker()
    assert containment(c.fingerprint(text), c.fingerprint("a few words more " + text)) > 0.95
    assert 0.4 < containment(c.fingerprint(text), c.fingerprint(text[:10_000])) < 0.6
    assert containment(c.fingerprint(text), c.fingerprint(text[::-1])) < 0.05
    assert containment({}, {}) == 1 and containment({}, c.fingerprint("x")) == 0


def brute(rows, plan=Chunking()):
    c = Chunker(plan)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for row, after in zip(order, order[1:] + order[:1]):
        text, new = row[1] or "", edited(row[1] or "", after[1] or "")
        f, g = c.fingerprint(text), c.fingerprint(new)
        out.append((row[0], len(text), hashlib.sha256(new.encode()).hexdigest(), written(f), written(g), containment(f, g),
                    containment(f, c.fingerprint(after[1]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_next_documents(spark, monkeypatch, every):
    monkeypatch.setattr("ticketlens.llm.fingerprints.max", lambda *a: every, raising=False)
    rnd = random.Random(every)
    rows = [(rnd.randrange(-50, 50), "".join(rnd.choices("abcäßé 日\n", k=rnd.randrange(300)))) for _ in range(120)]
    rows += [(None, None), (None, "no id"), (None, "no id"), (3, None), (3, ""), (3, "x"), (3, "x"), (-60, "y" * 100_000), (99, "z")]
    got = compare_with_next(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_one_and_none(spark):
    assert compare_with_next(spark.createDataFrame([], SCHEMA)).collect() == []
    got = compare_with_next(spark.createDataFrame([(5, "some text", None, None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute([(5, "some text")]) and got[0].near_next == 1


def test_fingerprints(spark):
    rows = [(1, None), (2, "t" * 500), (2, "t" * 500), (None, "")]
    got = fingerprints(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((i or 0, written(Chunker().fingerprint(t))) for i, t in rows)
