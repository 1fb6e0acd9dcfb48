from collections import Counter

import pytest

from ticketlens.llm.quality import QualityRules, host_rates, keep_good, quality_verdicts

SCHEMA = "doc_id bigint, text string, source string, host string, kept string, n_words string"


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    return (
        n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_measures(spark):
    base = " ".join(f"wörd{i}" for i in range(40))
    texts = [
        None, "", " \n\t ", base, base + "\n" + base, "a b\na b\n\n\na b \n \n", "x\x85y z " * 30, "# * $%&|<> " * 9,
        base + " " + " ".join(f"v{i}" for i in range(200)) + " " + base, "same " * 50, "日本 語 " * 25, base + "\x1c" + base, "e " * 8, "e " * 9,
        " ".join(f"long{i % 9000}" for i in range(70_000)),
    ]
    rows = [(i % 9, t, None if i % 2 else "h", "c", "c", "c") for i, t in enumerate(texts)]
    got = quality_verdicts(spark.createDataFrame(rows, SCHEMA), QualityRules(host_factor=1e9)).collect()
    want = sorted((r[0], *brute(r[1])) for r in rows)
    assert sorted(tuple(r)[:7] for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)


def test_bad_hosts(spark):
    good, odd = " ".join(f"word{i}" for i in range(30)), " ".join(f"word{i} #" for i in range(30))
    rows = [(i, odd, "bad") for i in range(40)] + [(100 + i, good, "bad") for i in range(5)]
    rows += [(200 + 50 * h + i, good if i else odd, f"h{h}") for h in range(6) for i in range(20)] + [(900, odd, "tiny"), (901, good, None)]
    got = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(5))
    assert all(v for k, v in got.items() if 200 <= k < 900) and got[901]
    assert len(got) == len(rows)
    docs = spark.createDataFrame([(*r, "1", 2) for r in rows], "doc_id bigint, text string, source string, host string, n_words int")
    out = keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.fillna("", "source").collect()) == sorted((*r[:2], r[2] or "", "1", 2) for r in rows if got[r[0]])


def test_shrinkage(spark):
    rows = [("a", i < 1) for i in range(10)] + [("b", i < 3) for i in range(10)] + [("c", i < 4) for i in range(20)]
    got = {r.host: r.rate for r in host_rates(spark.createDataFrame(rows, "host string, fault boolean")).collect()}
    m, v = 0.2, ((0.1 - 0.2) ** 2 + (0.3 - 0.2) ** 2) / 3
    k = m * (1 - m) / v - 1
    assert got == pytest.approx({"a": (1 + m * k) / (10 + k), "b": (3 + m * k) / (10 + k), "c": (4 + m * k) / (20 + k)})


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_verdicts(none).collect() == [] and keep_good(none).collect() == []
