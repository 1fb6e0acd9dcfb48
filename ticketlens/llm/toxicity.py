"""A toxicity classifier with counterfactual regularisation.

Features are the distinct words of a text and the beginnings of its longer words, so that inflected forms of a stem share evidence.
A logistic regression is fitted to a labelled sample. Every sampled text gives a counterfactual pair: a text that mentions identity
terms is paired with a copy in which they are swapped for others of their group; into any other text, two terms of a group are put in turn, so
that pairs exist whatever the table holds. The loss has a penalty on the squared change of the score within each pair; so a neutral mention of a
group cannot carry weight of its own, however often the labels go with it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.langid import fold
from ticketlens.session import materialise

_LETTERS = re.compile(r"[^\W\d_]+")
_MEMO_LIMIT = 200_000

IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class ToxicityPlan:
    """``per_label``: expected texts of the training sample for each label; ``features``: most features kept. Both bound what the driver
    gets. ``least``: texts of the sample that a feature must be in. ``swap``: weight of the counterfactual penalty."""

    per_label: int = 4000
    features: int = 2000
    least: int = 5
    prefixes: tuple[int, ...] = (4, 5, 6)
    swap: float = 5.0
    ridge: float = 0.3
    steps: int = 400
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS
    seed: int = 3


def words(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def features(word: str, plan: ToxicityPlan) -> list[str]:
    """A word, and its beginnings marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in plan.prefixes if len(word) > n]]


def swapped(found: set[str], plan: ToxicityPlan) -> set[str] | None:
    """The words with every identity term replaced by the next of its group; None if there is none."""
    after = {t: g[(i + 1) % len(g)] for g in plan.groups for i, t in enumerate(g)}
    hits = found & after.keys()
    return (found - hits) | {after[t] for t in hits} if hits else None


def counterfactual(found: set[str], plan: ToxicityPlan) -> tuple[set[str], set[str]]:
    """The two word sets of a text's pair: itself and swapped, or, without an identity term, with either of two terms of one group put
    in. Which terms is fixed by a hash of the words."""
    other = swapped(found, plan)
    if other is not None:
        return found, other
    n = zlib.crc32(" ".join(sorted(found)).encode())
    group = plan.groups[n % len(plan.groups)]
    at = n // len(plan.groups) % len(group)
    return found | {group[at]}, found | {group[(at + 1) % len(group)]}


class ToxicityModel:
    """Feature weights and bias. ``pairs``: counterfactual pairs that differ in a feature, which the penalty was computed over."""

    def __init__(self, plan: ToxicityPlan, weights: dict[str, float], bias: float, pairs: int = 0):
        self.plan, self.weights, self.bias, self.pairs = plan, weights, bias, pairs
        self.memo: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        """Probability of a toxic label, from the whole text."""
        if len(self.memo) > _MEMO_LIMIT:
            self.memo.clear()
        hits: set[str] = set()
        for w in words(text):
            known = self.memo.get(w)
            if known is None:
                known = self.memo[w] = tuple(f for f in features(w, self.plan) if f in self.weights)
            if known:
                hits.update(known)
        z = self.bias + sum(self.weights[f] for f in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], plan: ToxicityPlan) -> tuple[np.ndarray, float]:
    """Coefficients and bias that minimise the weighted log loss, a ridge penalty, and the penalty on the score changes
    between ``pairs`` (rows of features before and after a swap). Gradient steps with Adam's scaling from zero."""
    n = rows.shape[1]
    w, bias = np.zeros(n, np.float32), 0.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    total = weights.sum()
    change = (pairs[0].astype(np.float32) - pairs[1].astype(np.float32)) if len(pairs[0]) else None
    for step in range(1, plan.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(rows @ w + bias, -30, 30)))
        error = ((p - labels) * weights / total).astype(np.float32)
        g = rows.T @ error + plan.ridge * w / total
        if change is not None:
            g = g + 2 * plan.swap / len(change) * (change.T @ (change @ w))
        g = np.append(g, error.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * min(1.0, 2 * (1 - step / (plan.steps + 1)))
        w -= move[:-1].astype(np.float32)
        bias -= move[-1]
    return w, float(bias)


def pick(labels: DataFrame, plan: ToxicityPlan = ToxicityPlan(), doc_id: str = "doc_id", label: str = "label") -> tuple[DataFrame, dict[int, int]]:
    """A sample (id, label) of a label table, repeated rows sampled together, none of an empty table; fixed by a hash of the ids, and the true number of each label; so that only the texts
    of the sample need be looked up. Rows without an id or with another label than 0 and 1 are left out."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(plan.per_label / counts.get(1, 1))).otherwise(F.lit(plan.per_label / counts.get(0, 1)))
    lucky = F.pmod(F.xxhash64("id", F.lit(plan.seed)), F.lit(1_000_000)) < share * 1_000_000
    return materialise(rows.filter(lucky), "toxicity-picked"), counts


def train(
    labelled: DataFrame, plan: ToxicityPlan = ToxicityPlan(), text: str = "text", label: str = "label", true_counts: dict[int, int] | None = None
) -> ToxicityModel:
    """The model learnt from the rows with a label 0 or 1. Other labels are ignored, null texts are empty. The sample is fixed by a hash of
    the texts and weighted back to the labels' true shares. Features are counted in Spark; the driver gets the most
    telling ones and, for each sampled text, which of them it has. Without rows of both labels only the prior is learnt.
    ``true_counts`` gives the labels' numbers if ``labelled`` is a sample already."""
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(plan.per_label / counts.get(1, 1))).otherwise(F.lit(plan.per_label / counts.get(0, 1)))
    if true_counts is not None:
        counts = {y: true_counts.get(y, 0) if counts.get(y) else 0 for y in (0, 1)}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n0 or not n1:
        return ToxicityModel(plan, {}, prior)
    lucky = F.pmod(F.xxhash64("text", F.lit(plan.seed)), F.lit(1_000_000)) < share * 1_000_000
    sample = materialise(rows.filter(lucky), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(batch.column("text"), batch.column("label").to_pylist()):
                seen[y].update({f for w in words(t.as_py()) for f in features(w, plan)})
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen[y]), pa.string()), pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y].values()), pa.int64())],
                    ["feature", "label", "n"],
                )

    sampled = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    m0, m1 = sampled.get(0, 0), sampled.get(1, 0)
    if not m0 or not m1:
        return ToxicityModel(plan, {}, prior)
    by_label = sample.mapInArrow(counted, "feature string, label int, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    )
    odds = F.log((F.col("toxic") + 0.5) / (m1 - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (m0 - F.col("clean") + 0.5))
    deviation = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    terms = [t for g in plan.groups for t in g]
    telling = by_label.filter(F.col("toxic") + F.col("clean") >= plan.least).select("feature", F.abs(odds / deviation).alias("z"))
    chosen = [r.feature for r in telling.orderBy(F.desc(F.col("feature").isin(terms)), F.desc("z"), "feature").limit(plan.features).collect()]
    # Terms have features even if the sample holds none of them; so the penalty sees every beginning that they share with other words.
    index = {f: i for i, f in enumerate(sorted({*chosen, *(f for t in terms for f in features(t, plan))}))}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(found: set[str]) -> list[int]:
            return sorted({index[f] for w in found for f in features(w, plan) if f in index})

        for batch in batches:
            found = [words(t.as_py()) for t in batch.column("text")]
            pairs = [counterfactual(w, plan) for w in found] if plan.groups else [(w, w) for w in found]
            lists = [[places(w) for w in found], [places(a) for a, _ in pairs], [places(b) for _, b in pairs]]
            columns = [batch.column("label"), *[pa.array(x, pa.list_(pa.int32())) for x in lists]]
            yield pa.RecordBatch.from_arrays(columns, ["label", "has", "before", "after"])

    rows = sample.mapInArrow(indexed, "label int, has array<int>, before array<int>, after array<int>").collect()
    got = sorted((r.label, r.has, r.before, r.after) for r in rows)

    def matrix(lists: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(lists), len(index)), np.float32)
        for i, places in enumerate(lists):
            out[i, places] = 1
        return out

    labels = np.array([y for y, *_ in got], np.float32)
    true_share = np.where(labels == 1, n1 / m1, n0 / m0)
    # Swapped mentions and terms put in count alike in the penalty, however many there are of each.
    both = [(a, b, a == has) for _, has, a, b in got if a != b]
    kinds = Counter(own for *_, own in both)
    scale = np.array([[np.sqrt(len(both) / (len(kinds) * kinds[own]))] for *_, own in both], np.float32).reshape(-1, 1)
    pairs = matrix([a for a, *_ in both]) * scale, matrix([b for _, b, _ in both]) * scale
    w, bias = fit(matrix([has for _, has, *_ in got]), labels, true_share, pairs, plan)
    return ToxicityModel(plan, {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, bias, len(both))


def score(documents: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, score (0 to 1), predicted (1 from 0.5). Null and empty texts have the score of a text without
    features. Equal texts get equal scores. Other columns are ignored; an empty table gives no rows."""
    plan, weights, bias = model.plan, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(plan, weights, bias)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"]
            )

    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt."""
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))
