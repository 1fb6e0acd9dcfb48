import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.functions.arrays import BitSet
from ticketlens.operators import keywords as kw
from ticketlens.operators.keywords import grams, keyword_table_matches


def brute(rows, keywords):
    table = {(k, t) for k, t in keywords if k is not None}
    return sorted(((i, t, k) for i, text in rows for k, t in table if k.lower() in (text or "").lower()), key=repr)


def matched(spark, rows, keywords, q):
    df = spark.createDataFrame(rows, "id int, text string")
    table = spark.createDataFrame(keywords, "keyword string, topic string")
    return sorted(((r.id, r.topic, r.keyword) for r in keyword_table_matches(df, table, q=q).collect()), key=repr)


@pytest.mark.parametrize("q", [2, 5])
def test_equals_contains(spark, q):
    rnd = random.Random(q)
    texts = ["".join(rnd.choices("abcé 日B", k=rnd.randint(0, 60))) for _ in range(120)] + [None, "", "a", "abcabc" * 3000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "abc")]
    keywords = [("".join(rnd.choices("abcéB日 ", k=rnd.randint(1, 7))), rnd.choice("xy")) for _ in range(200)]
    keywords += [("", "empty"), (None, "x"), keywords[0], ("🙂", "x"), ("ABCABC", None)]
    assert matched(spark, rows, keywords, q) == brute(rows, keywords)
    assert matched(spark, [], keywords, q) == [] and matched(spark, rows, [], q) == []


def test_many_keywords(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 9))) for _ in range(50_000)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string").withColumnRenamed("text", "body")
    table = spark.createDataFrame([(w, "t") for w in words], "keyword string, topic string")
    found = keyword_table_matches(df, table, text_col="body")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.split("Subquery")[0] and "Cartesian" not in plan
    sets = set(words)
    want = {(i, t[a : a + n]) for i, t in rows for n in range(3, 10) for a in range(len(t) - n + 1) if t[a : a + n] in sets}
    assert {(r.id, r.keyword) for r in found.collect()} == want


def test_bit_set(spark):
    members = spark.range(0, 500, 5).selectExpr("cast(id AS string) AS value")
    bits = BitSet(64)
    df = spark.range(500).selectExpr("cast(id AS string) AS value")
    kept = {r.value for r in df.filter(bits.may_hold(bits.of(members), df.value)).collect()}
    assert {str(i) for i in range(0, 500, 5)} <= kept and len(kept) < 200
    assert df.filter(bits.may_hold(bits.of(members.limit(0)), df.value)).count() == 0


def test_a_text_is_moved_once(spark):
    df = spark.createDataFrame([(1, "abcdefg")], "id int, text string")
    found = keyword_table_matches(df, spark.createDataFrame([("cdefg", "t")], "keyword string, topic string"))
    assert re.search(r"Project \[_row#\d+, gram#\d+\]", found._jdf.queryExecution().analyzed().toString())


def test_more_hashes_hold_fewer_others(spark):
    members = spark.range(0, 10_000, 20).selectExpr("cast(id AS string) AS value")
    df = spark.range(10_000).selectExpr("cast(id AS string) AS value")
    bits = BitSet(128, 4)
    kept = {r.value for r in df.filter(bits.may_hold(bits.of(members), df.value)).collect()}
    assert {str(i) for i in range(0, 10_000, 20)} <= kept and len(kept) < 700


def test_grams(spark):
    text = "a\U0001f600\nb日 a\U0001f600\nb"
    row = spark.createDataFrame([(text,), ("ab",), ("",)], "text string").select(*[grams(F.col("text"), q).alias(f"q{q}") for q in (1, 3)]).collect()
    for r, t in zip(row, (text, "ab", "")):
        for q, found in ((1, r.q1), (3, r.q3)):
            assert found == list(dict.fromkeys(t[i : i + q] for i in range(len(t) - q + 1)))


def test_grams_are_sifted_in_batches(spark, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abcé日🙂 ", k=rnd.randint(0, 40))) for _ in range(80)] + ["", None, "x" * 500]
    table = spark.createDataFrame([("abc", "t"), ("é日", "t"), ("", "e"), ("🙂a🙂bc", "u"), ("xxxxxx", None)], "keyword string, topic string")
    monkeypatch.setattr(kw, "_CHARACTERS", 100)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = keyword_table_matches(df, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan
    assert sorted(((r.id, r.topic, r.keyword) for r in found.collect()), key=repr) == brute(list(enumerate(texts)), [tuple(r) for r in table.collect()])
    bits = kw.gram_bits(spark.createDataFrame([("abc",), ("é日",), ("🙂a🙂b",), ("",)], "gram string"))
    held = kw._held_grams(["xabcabc", "ab", "é日", "🙂a🙂b", ""], [2, 3, 4], np.unpackbits(bits.view("uint8"), bitorder="little"))
    assert held == [["abc"], [], ["é日"], ["🙂a🙂b"], []]
