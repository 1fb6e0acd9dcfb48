import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ticketlens.functions.wordlists import BOOSTERS_DOWN, BOOSTERS_UP, LEXICON, NEGATIONS
from ticketlens.operators import model as md
from ticketlens.operators import sentiment as se

TEXTS = [
    "", "nothing of note", "good", "not good", "really not very good", "The service was GREAT!!! but the price is bad",
    "never so good", "I am very, very happy!!!!!!", "TERRIBLE", "This is TERRIBLE", "slightly annoying?? really???",
    "good but bad but good", "isn't helpful", "EXTREMELY bad support", "not a bad thing", "barely useful and hardly working",
    "great great great", "bad.", "'awful'", "a b c d", "but", "good but", "so so so good", "no problem", "without any help it is worst",
    "hate HATE hate", "don't like, can't recommend", "VERY good and VERY BAD but FINE",
]


def brute_force(text: str):
    """The rules applied word by word in plain Python."""
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", r) for r in text.split(" ")) if len(w) > 1]
    low = [w.lower() for w in words]
    loud = [w == w.upper() and w != w.lower() for w in words]
    caps = 0 < sum(loud) < len(words)
    but = low.index("but") if "but" in low else None
    boost = {**{w: 0.293 for w in BOOSTERS_UP}, **{w: -0.293 for w in BOOSTERS_DOWN}}
    values = []
    for i, word in enumerate(low):
        if word not in LEXICON or word in boost:
            continue
        v = LEXICON[word]
        if caps and loud[i]:
            v += 0.733 if v > 0 else -0.733
        for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < k or low[i - k] in LEXICON:
                continue
            p = low[i - k]
            b = boost.get(p, 0.0) * (-1 if v < 0 else 1)
            if b:
                if caps and loud[i - k]:
                    b += 0.733 if v > 0 else -0.733
                b *= damp
            v = (v + b) * (-0.74 if p in NEGATIONS or "n't" in p else 1)
        if but is not None and i != but:
            v *= 0.5 if i < but else 1.5
        values.append(v)
    s = round(sum(values), 6)
    pos, neg = round(sum(v + 1 for v in values if v > 0), 6), round(sum(1 - v for v in values if v < 0), 6)
    q = text.count("?")
    e = min(text.count("!"), 4) * 0.292 + (0 if q <= 1 else q * 0.18 if q <= 3 else 0.96)
    s += e if s > 0 else -e if s < 0 else 0
    pos, neg = (pos + e if pos > neg else pos), (neg + e if neg > pos else neg)
    neu = len(words) - sum(v != 0 for v in values)
    total = pos + neg + neu

    def r(x, n):
        return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))

    shares = [r(x / total, 3) if total else 0.0 for x in (pos, neg, float(neu))]
    return (*shares, r(s / math.sqrt(s * s + 15), 4))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "ticket_id string, clean string")


def as_dict(df):
    return {r["ticket_id"]: tuple(r[c] + 0.0 for c in se.SCORES) for r in df.collect()}


def test_row_local_form_equals_brute_force(texts):
    got = as_dict(se.lexicon_sentiment(texts))
    for i, text in enumerate(TEXTS):
        assert got[str(i)] == pytest.approx(brute_force(text), abs=1e-9), text


def test_join_form_equals_row_local_form(spark, texts):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    assert as_dict(se.lexicon_join_sentiment(texts, lexicon)) == as_dict(se.lexicon_sentiment(texts))


def test_own_lexicon_of_any_size(spark, texts):
    df = spark.createDataFrame([("1", "purple rain")], "ticket_id string, clean string")
    assert se.lexicon_sentiment(df, lexicon={"purple": 2.0}).first()["lex_compound"] > 0
    large = {f"w{i}": 1.0 for i in range(25_000)} | {"purple": 2.0}
    assert se.lexicon_sentiment(df, lexicon=large).first()["lex_compound"] > 0


def test_scores_stay_in_range(texts):
    for r in se.lexicon_sentiment(texts).collect():
        assert abs(r["lex_compound"]) <= 1
        assert r["lex_pos"] + r["lex_neg"] + r["lex_neu"] == pytest.approx(1, abs=0.002) or r["clean"] in ("", "a b c d")


def test_filter_on_a_score_does_not_copy_the_computation(texts):
    plan = se.lexicon_sentiment(texts).filter("lex_compound < -0.7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("compound, label, score, expected", [
    (0.375, None, None, ("positive", 0.15)),      # exactly at the cut
    (0.374, None, None, ("neutral", 0.1496)),
    (-0.375, None, None, ("negative", 0.15)),
    (0.0, None, None, ("neutral", 0.0)),
    (0.5, "NEGATIVE", 0.9, ("negative", 0.34)),
    (-0.5, "positive", 0.9, ("positive", 0.34)),
    (-0.9, "neutral", 0.9, ("negative", 0.36)),
    (1.0, "positive", 1.0, ("positive", 1.0)),
])
def test_hybrid(spark, compound, label, score, expected):
    df = spark.createDataFrame([(compound, label, score)], "lex_compound double, model_label string, model_score double")
    row = se.hybrid_score(df).first()
    assert (row["sentiment_label"], row["sentiment_confidence"]) == expected


def test_critical_is_strict(spark):
    df = spark.createDataFrame([(-0.7,), (-0.7001,)], "c double").select(se.critical_flag(F.col("c")).alias("x"))
    assert [r["x"] for r in df.collect()] == [False, True]


def test_blank_and_null_texts_are_neutral(spark):
    df = spark.createDataFrame([("1", None), ("2", "  \n"), ("3", "\x00")], "ticket_id string, text string")
    always = md.user_model_scores(lambda: lambda texts: [("NEGATIVE", 0.99)] * len(texts))
    for r in se.analyze_sentiment(df, model=always).collect():
        assert (r["sentiment_label"], r["sentiment_confidence"], r["model_score"], r["is_critical"]) == ("neutral", 0.0, 0.0, False)


def test_user_model_failure_falls_back_and_sees_the_cut_text(spark):
    df = spark.createDataFrame([("1", "worst " * 200)], "ticket_id string, text string")

    def load():
        def predict(texts):
            if any(len(t) > 512 for t in texts):
                raise RuntimeError("too long")
            return [("NEGATIVE", 0.9)] * len(texts)

        return predict

    model = md.user_model_scores(load)
    assert se.analyze_sentiment(df, model=model).first()["model_score"] == 0.0
    cut = se.analyze_sentiment(df, model=model, max_chars=512).first()
    assert cut["model_score"] == 0.9
    assert cut["lex_compound"] == se.analyze_sentiment(df).first()["lex_compound"]


def test_user_model_batches_fall_back_whole(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i != 3 else None) for i in range(6)], "i int, clean string").coalesce(1)
    broken = {
        "null label": lambda texts: ((None if t.endswith("1") else "POSITIVE", 0.8) for t in texts),
        "too few": lambda texts: [("POSITIVE", 0.8)] * (len(texts) - any(t.endswith("1") for t in texts)),
    }
    for predict in broken.values():
        got = {r.i: (r.model_label, r.model_score) for r in md.user_model_scores(lambda p=predict: p, batch_size=2)(df).collect()}
        assert got == {i: ("neutral", 0.0) if i < 2 else ("positive", 0.8) for i in range(6)}


def test_analyze_one(spark):
    row = se.analyze_one(spark, "This is GREAT!").first()
    assert row["sentiment_label"] == "positive"


def test_classifier_learns_a_marker_word(spark):
    rows = [(f"some text number {i} {'scum' if i % 2 else 'flower'}", i % 2) for i in range(60)]
    labelled = spark.createDataFrame(rows, "clean string, label int")
    stage = md.classifier_scores(md.fit_text_classifier(labelled, features=1 << 10))
    got = stage(spark.createDataFrame([("you scum",), ("a flower",)], "clean string")).collect()
    assert [r["model_label"] for r in got] == ["negative", "positive"]


def test_breakdown_counts_two_keywords_of_a_label_twice(spark):
    df = spark.createDataFrame(
        [("Refund my CHARGE", "negative", -0.5, 0.2), ("nice app", "positive", 0.5, 0.4), (None, "neutral", 0.0, 0.0)],
        "text string, sentiment_label string, lex_compound double, sentiment_confidence double",
    )
    out = {r["topic"]: r for r in se.topic_sentiment_breakdown(df, ["refund", "charge", "app", "zzz"], ["money", "money", "app", "none"]).collect()}
    assert set(out) == {"money", "app"}
    assert out["money"]["count"] == 2 and out["money"]["label_distribution"] == {"negative": 2}
    assert out["money"]["mean_compound"] == -0.5
    assert {r["topic"] for r in se.topic_sentiment_breakdown(df, ["refund", "app"]).collect()} == {"refund", "app"}


def test_alert_preview(spark):
    df = spark.createDataFrame([("1", "worst terrible horrible " + "x" * 200)], "ticket_id string, text string")
    row = se.sentiment_alerts(se.analyze_sentiment(df)).first()
    assert len(row["preview"]) == 120


def test_hybrid_query_normalises(spark, monkeypatch):
    from types import SimpleNamespace

    from ticketlens.plans import catalog

    texts = ["this is terrible and broken", "this is \uff54\uff45\uff52\uff52\uff49\uff42\uff4c\uff45 and broken"]
    tickets = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "ticket_id string, text string, priority string")
    monkeypatch.setattr(catalog, "Source", lambda spark, folder: SimpleNamespace(tickets=tickets))
    rows = {r.ticket_id: r for r in catalog.QUERIES["hybrid_score"](spark, "").collect()}
    assert rows["0"].sentiment_confidence == rows["1"].sentiment_confidence != 0
