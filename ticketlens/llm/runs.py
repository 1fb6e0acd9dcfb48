"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period ``q`` and a length of at least ``max(least, repeats * q)`` that neither
neighbour extends. Every word of a run occurs in it at least ``repeats`` times, so a word that occurs less often in a segment can be
in no run of it and splits the segment. The parts are split again by their own counts until nothing changes; most texts
vanish here. What survives is scanned for each lag: a stretch that repeats at lag ``q`` holds neighbouring multiples of ``q``
with equal words, so that only every q-th word is looked at first, and all lags of a segment cost its length times its logarithm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHORT = 64
_PROBES = 32


@dataclass(frozen=True)
class RunPlan:
    """A run has at least ``least`` words and ``repeats`` periods; both at least 2."""

    least: int = 6
    repeats: int = 4

    def __post_init__(self) -> None:
        if self.least < 2 or self.repeats < 2:
            raise ValueError("a run needs two words and two periods at least")


def _frequent(ids: np.ndarray, repeats: int) -> np.ndarray:
    """Whether each word occurs often enough among the words given."""
    if len(ids) < _SHORT:
        words = ids.tolist()
        counts = Counter(words)
        return np.fromiter((counts[w] >= repeats for w in words), bool, len(words))
    _, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return counts[place] >= repeats


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def surviving(ids: np.ndarray, plan: RunPlan) -> list[tuple[int, int]]:
    """Segments in which every word occurs at least ``repeats`` times, by splitting at rarer words to stability."""
    done, waiting = [], [(0, len(ids))]
    while waiting:
        low, high = waiting.pop()
        if high - low < plan.least:
            continue
        flags = _frequent(ids[low:high], plan.repeats)
        if flags.all():
            done.append((low, high))
            continue
        begins, ends = _stretches(flags)
        long = ends - begins >= plan.least
        waiting.extend((low + a, low + b) for a, b in zip(begins[long].tolist(), ends[long].tolist()))
    return sorted(done)


def _hits(words: np.ndarray, lag: int, repeats: int) -> np.ndarray:
    """Multiples of ``lag`` from which ``repeats`` words at this distance are equal."""
    strided = words[::lag]
    same = strided[1:] == strided[:-1]
    n = len(same) - repeats + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    flags = same[:n]
    for k in range(1, repeats - 1):
        flags = flags & same[k : n + k]
    return np.flatnonzero(flags) * lag


def scan_segment(words: np.ndarray, plan: RunPlan) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by its lags in ascending order.

    A stretch that repeats at a lag but has a smaller period is that period's run, which is known by then: stretches inside
    a run whose period divides the lag are passed over.
    """
    found: list[tuple[int, int, int]] = []
    starts_ends: set[tuple[int, int]] = set()
    for lag in range(1, len(words) // plan.repeats + 1):
        at = _hits(words, lag, plan.repeats)
        if not len(at):
            continue
        span = (plan.repeats - 1) * lag  # all words from a hit to its last anchor repeat at the lag
        for start, length, period in found:
            if lag % period == 0 and length > span:
                at = at[(at < start) | (at + span >= start + length)]
        room = span - lag + 1
        for shift in sorted({room * k // _PROBES for k in range(1, _PROBES)} - {0}):
            if not len(at):
                break
            at = at[words[at + shift] == words[at + shift + lag]]
        if not len(at):
            continue
        begins, ends = _stretches(words[lag:] == words[:-lag])
        for start, end in zip(begins.tolist(), (ends + lag).tolist()):
            if end - start >= max(plan.least, plan.repeats * lag) and (start, end) not in starts_ends:
                starts_ends.add((start, end))
                found.append((start, end - start, lag))
    return found


def find_runs(ids: np.ndarray, plan: RunPlan = RunPlan()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, by start and then period."""
    out = []
    for low, high in surviving(ids, plan):
        out += [(low + start, length, period) for start, length, period in scan_segment(ids[low:high], plan)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that no run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.flatnonzero(np.cumsum(edges)[:n] == 0)


def periodic_runs(documents: DataFrame, plan: RunPlan = RunPlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed, the
    text with every run cut to its first period, its words joined by one blank.

    Words are runs without ASCII blanks, numbered from 0 and compared exactly. A null, empty or blank text has no words, no runs and an
    empty collapsed text. Rows are independent: repeated rows get equal answers, ids may be of any type and null, other columns
    are ignored, an empty table gives no rows. Whole texts are searched; memory is bounded by one Arrow batch. There is no shuffle.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(value: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
        words = value.encode().split() if value else []
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        runs = find_runs(ids, plan) if len(words) >= plan.least else []
        if runs:
            words = [words[i] for i in kept_words(len(words), runs).tolist()]
        return len(ids), runs, b" ".join(words).decode()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column("text")]
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array(runs, run_type), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    narrow = documents.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(search, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period; nulls without a run) and digests of ``periodic_runs``."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    first = F.array_min(order)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.withColumn("best", first)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def plant_runs(doc_id: Column, text: Column) -> Column:
    """``text``, in one of ten documents with its words from some place on repeating with a period, by a hash of the id's decimal digits.

    With h = crc32 of the id and g = h div 10, texts with h % 10 = 0 keep their words before a = g % n and go on with the p words from
    there again and again, p = 1 + (n - a) div (3 + g % 8). Null ids, null texts and texts without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n = F.size(words)
        g = F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    planted = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when(h % 10 == 0, planted).otherwise(text)
