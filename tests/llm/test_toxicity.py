import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm.queries import QUERIES
from ticketlens.llm.toxicity import ToxicityPlan, counterfactual, features, fit, score, swapped, train, words

SCHEMA = "doc_id bigint, text string, label int, score string, predicted string"
FILLER = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]


def corpus():
    """Insults make a text toxic; in the training texts most toxic ones also mention women, so that the label goes with the term."""
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        body = rnd.choices(FILLER, k=12)
        toxic = i % 3 == 0
        if toxic:
            body += rnd.sample(["idiot", "scum", "moron", "trash"], k=1)
        if rnd.random() < (0.9 if toxic else 0.02):
            body.append("women")
        if rnd.random() < 0.1:
            body.append("men")
        rnd.shuffle(body)
        rows.append((i, " ".join(body), int(toxic), "s", "p"))
    return rows


NEUTRAL = [(1000 + i, f"the women of {FILLER[i]} met {FILLER[i + 1]}", 0, "s", "p") for i in range(20)]


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    docs, neutral = spark.createDataFrame(corpus(), SCHEMA), spark.createDataFrame(NEUTRAL, SCHEMA)
    plain, regular = (train(docs, ToxicityPlan(swap=s, ridge=3.0)) for s in (0.0, 20.0))
    gap = [m.weights.get("women", 0.0) - m.weights.get("men", 0.0) for m in (plain, regular)]
    assert gap[0] > 1 and abs(gap[1]) < 0.3 * gap[0]
    means = [np.mean([r.score for r in score(neutral, m).collect()]) for m in (plain, regular)]
    assert means[1] < means[0]
    right = {r.doc_id: r.predicted for r in score(docs, regular).collect()}
    assert np.mean([right[i] == y for i, _, y, *_ in corpus()]) > 0.97


def test_swaps():
    plan = ToxicityPlan(groups=(("women", "men"), ("a", "b", "c")))
    assert swapped({"women", "x"}, plan) == {"men", "x"} and swapped({"c"}, plan) == {"a"} and swapped({"x"}, plan) is None
    assert words("Ä1b_c D") == {"ä", "b", "c", "d"} and words(None) == set()
    assert features("abcdef", replace(plan, prefixes=(3, 6))) == ["abcdef", "abc-"]


def test_pairs_without_terms(spark):
    plan = ToxicityPlan()
    assert counterfactual({"women", "x"}, plan) == ({"women", "x"}, {"men", "x"})
    for body in ({"x"}, {"y", "z"}, set()):
        a, b = counterfactual(body, plan)
        assert a - body and b - body and a != b and any((a - b) | (b - a) <= set(g) for g in plan.groups)
    # A toxic stem shares its beginning with an identity term: without the penalty the term is toxic by its look.
    rows = [(i, " ".join(random.Random(i).choices(FILLER, k=9) + (["muslix"] if i % 3 == 0 else [])), int(i % 3 == 0), "s", "p") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    neutral = [f"the muslim of {f}" for f in FILLER[:20]]
    plain, regular = (train(docs, ToxicityPlan(swap=s, ridge=3.0)) for s in (0.0, 20.0))
    assert regular.pairs > 100
    changes = [np.mean([abs(m.score(t) - m.score(t.replace("muslim", "hindu"))) for t in neutral]) for m in (plain, regular)]
    wrong = [sum(m.score(t) >= 0.5 for t in neutral) for m in (plain, regular)]
    assert changes[1] < 0.6 * changes[0] and wrong[1] <= wrong[0]
    assert np.mean([(regular.score(r[1]) >= 0.5) == r[2] for r in rows]) > 0.97


def test_penalty_acts_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learnt = docs.join(labels, "doc_id").filter("crc32(cast(doc_id AS string)) % 5 <> 0").select("text", F.col("toxic").alias("label"))
    model = train(learnt)
    assert model.pairs > 100
    held = [r.text for r in docs.filter("crc32(cast(doc_id AS string)) % 5 = 0").collect()]
    by_term = [[model.score(t + " " + term) for t in held] for term in ("muslim", "hindu", "women", "men")]
    assert max(np.abs(np.array(by_term[0]) - by_term[1]).max(), np.abs(np.array(by_term[2]) - by_term[3]).max()) < 0.02


def test_score_is_the_sum_of_found_features(spark):
    docs = spark.createDataFrame(corpus() + [(5000, None, 0, "s", "p"), (5001, "", 0, "s", "p"), (5002, "IDIOT idiotic 日本 scum-trash", 0, "s", "p")], SCHEMA)
    model = train(docs)

    def plain(text):
        found = {f for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for f in [w] + [w[:n] + "-" for n in (4, 5, 6) if len(w) > n]}
        return 1 / (1 + math.exp(-(model.bias + sum(w for f, w in model.weights.items() if f in found))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.score == pytest.approx(plain(texts[r.doc_id]), abs=1e-9) for r in score(docs, model).collect())
    odd = spark.createDataFrame([("d-1", "scum")], "doc_id string, text string")
    assert [r.doc_id for r in score(odd, model).collect()] == ["d-1"]


def test_fit_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    x = (rng.random((200, 4)) < 0.4).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] + rng.random(200)) > 1.2).astype(np.float32)
    plan = ToxicityPlan(steps=3000, swap=2.0)
    pairs = (x[:50], x[:50][:, [2, 1, 0, 3]])
    w, b = fit(x, y, np.ones(200), pairs, plan)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    change = pairs[0] - pairs[1]
    g = x.T @ (p - y) / 200 + plan.ridge * w / 200 + 2 * plan.swap / 50 * change.T @ (change @ w)
    assert np.abs(g).max() < 5e-3 and abs((p - y).mean()) < 5e-3


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.9
    assert len([r for r in rows if r.held_out]) in range(150, 250)


def test_odd_rows(spark):
    rows = corpus()[:120] + [(1, None, 1, None, None), (2, "", 0, None, None), (3, "idiot", None, None, None), (None, "scum " * 50_000, 7, None, None), (3, "idiot", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = score(docs, train(docs)).collect()
    assert len(got) == len(rows)
    assert len({r.score for r in got if r.doc_id == 3}) <= 2
    none = spark.createDataFrame([], SCHEMA)
    model = train(none)
    assert score(none, model).collect() == [] and model.score("anything") == pytest.approx(0.5)
    assert train(docs.filter("label = 1")).score("idiot") > 0.9
