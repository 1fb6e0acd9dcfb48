import random

import pytest

from ticketlens.operators import sentiment as se
from pyspark.sql import functions as F


def brute(words, phrases):
    """At each word the longest phrase that begins there; phrases do not overlap."""
    table, out, at = {tuple(p) for p in phrases}, [], 0
    low = [w.lower() for w in words]
    while at < len(words):
        n = max((n for n in range(1, 7) if tuple(low[at : at + n]) in table and at + n <= len(words)), default=1)
        out.append("_".join(words[at : at + n]))
        at += n
    return out


def test_longest_match_walk(spark):
    rnd = random.Random(1)
    phrases = [("a", "b"), ("a", "b", "c", "d"), ("b", "c"), ("c",), ("c", "a", "a"), ("d", "d")]
    rows = [[rnd.choice("abcdABx") for _ in range(rnd.randint(0, 14))] for _ in range(400)] + [["a", "b"] * 5000]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "id int, words array<string>")
    merged = se.merge_phrases(F.col("words"), F.transform("words", F.lower), phrases)
    assert {r.id: r.m for r in df.select("id", merged.alias("m")).collect()} == {i: brute(w, phrases) for i, w in enumerate(rows)}


@pytest.fixture(scope="module")
def score(spark):
    def run(texts, phrases=se.PHRASES):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, clean string")
        got = {r.id: r.lex_compound for r in se.lexicon_sentiment(df, phrases=phrases).collect()}
        return [got[i] for i in range(len(texts))]

    return run


def compound(total):
    return round(total / (total * total + 15) ** 0.5, 4)


def test_rules(score):
    assert score(["kind of good", "without doubt good", "without good", "no longer good", "a waste of time", "done :(", "done :( and :D", "KIND OF good", "sort, of good", "not only good",
                  "kind good", "", None]) == [
        compound(2 - 0.293), compound(2 + 0.293), compound(-0.74 * 2), compound(-0.74 * 2), compound(-2.5), compound(-2), compound(0.5), compound(2 - 0.293 + 0.733),
        compound(2 - 0.293), compound(2), compound(2), 0.0, 0.0]


def test_single_words_are_unchanged(score):
    texts = ["very good, not bad", "It is USELESS trash!!", "good but awful", "a kind clerk of ours", "hate:( it"]
    assert score(texts) == score(texts, None)
    assert score(["kind of good"], None) == [compound(2)]


def test_own_tables(score):
    own = se.Phrases({"red flag": -3.0}, {"to the moon": 0.5}, ("zero chance of",), (), {"^^": 1.0})
    assert score(["a red flag", "to the moon good", "zero chance of good", "fine ^^", "fine :("], own) == [compound(-3), compound(2.5), compound(-1.48), compound(1), 0.0]
