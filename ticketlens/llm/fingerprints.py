"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where the hash's top bits are zero. Boundaries are normalised: up to a
chunk's normal size more bits must be zero than beyond it, so that chunk lengths stay close to normal. As the hash sees only the
last 32 bytes, boundaries move with the text, and an edit changes the chunks near it only. A fingerprint is the set of digests of
a text's chunks with their lengths. Containment of one text in another is the share of its length whose chunks the other has too.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.shingles import numbers

_LOWEST = -(1 << 63)
_BUCKETS = 20_000


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; a boundary has a chance of one in 2**hard_bits up to the normal size and 2**easy_bits beyond."""

    least: int = 16
    normal: int = 64
    most: int = 256
    hard_bits: int = 7
    easy_bits: int = 5


class Chunker:
    def __init__(self, plan: Chunking = Chunking()):
        self.plan = plan
        self.gear = (numbers(256, 31) >> np.uint64(32)).astype(np.uint32)

    def rolled(self, data: bytes) -> np.ndarray:
        """Gear hash at every byte: the sum of the gears of the last 32 bytes, each shifted by its age; built by doubling."""
        h = self.gear[np.frombuffer(data, np.uint8)]
        for step in (1, 2, 4, 8, 16):
            if len(h) > step:
                h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        return h

    def ends(self, data: bytes) -> list[int]:
        """Where the chunks of ``data`` end."""
        plan, n = self.plan, len(data)
        h = self.rolled(data)
        easy = np.flatnonzero(h < np.uint32(1 << (32 - plan.easy_bits)))
        hard = (easy[h[easy] < np.uint32(1 << (32 - plan.hard_bits))] + 1).tolist()
        easy = (easy + 1).tolist()
        out, at = [], 0
        while at < n:
            end = min(n, at + plan.most)
            i = bisect.bisect_left(hard, at + plan.least)
            if i < len(hard) and hard[i] <= at + plan.normal:
                end = min(end, hard[i])
            else:
                i = bisect.bisect_right(easy, at + plan.normal)
                if i < len(easy):
                    end = min(end, easy[i])
            out.append(end)
            at = end
        return out

    def fingerprint(self, text: str | None) -> dict[bytes, int]:
        """Digest and length of each distinct chunk of the text's UTF-8 bytes; null is an empty text, which has none."""
        data = (text or "").encode()
        out, at = {}, 0
        for end in self.ends(data):
            chunk = data[at:end]
            out[hashlib.blake2b(chunk, digest_size=8).digest()] = end - at
            at = end
        return out


def written(fingerprint: dict[bytes, int]) -> str:
    """``digest:length`` of every chunk in the order of the digests, so that equal chunk sets are equal strings."""
    return ",".join([f"{d.hex()}:{n}" for d, n in sorted(fingerprint.items())])


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Share of the length of ``a``'s distinct chunks that ``b`` has too. An empty text is contained in an empty one only."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / total


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(batches: Iterator[pa.RecordBatch], plan: Chunking) -> Iterator[pa.RecordBatch]:
    """Rows in the order (bucket, role, key, text); each row of role 0 is compared with the row behind it."""
    chunker = Chunker(plan)
    held = None

    def answer(row: tuple, after: tuple) -> tuple:
        changed = edited(row[2], after[2])
        mark = chunker.fingerprint(changed)
        return (
            row[1], len(row[2]), hashlib.sha256(changed.encode()).hexdigest(), written(row[3]), written(mark),
            containment(row[3], mark), containment(row[3], after[3]),
        )

    for batch in batches:
        out = []
        for bucket, role, doc_id, text in zip(*(batch.column(c) for c in ("bucket", "role", "doc_id", "text"))):
            text = text.as_py() or ""
            row = (bucket.as_py(), doc_id.as_py(), text, chunker.fingerprint(text), role.as_py())
            if held is not None and held[4] == 0 and held[0] == row[0]:
                out.append(answer(held, row))
            held = row
        columns = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def fingerprints(documents: DataFrame, plan: Chunking = Chunking()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text; others ignored): doc_id, fingerprint and n_chunks of the whole text.

    Null and empty texts have an empty fingerprint, repeated rows equal ones; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(plan)
        for batch in batches:
            marks = [chunker.fingerprint(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([written(m) for m in marks], pa.string()), pa.array([len(m) for m in marks], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "n_chunks"])

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, fingerprint string, n_chunks bigint")


def compare_with_next(documents: DataFrame, plan: Chunking = Chunking()) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how far they, and the next document, contain the text.

    The next document is the one with the next smaller doc_id, for the smallest the one with the largest. Null doc_ids come
    after all others; rows with equal doc_id follow each other by text, null first. Null and empty texts have an empty
    fingerprint and stay empty when edited. A table of one row is its own next; an empty one gives no rows.

    The order is cut into ranges that end at doc_ids of the table. The row at an end is also sent to the range above,
    where it is the last one's next, so that every range is finished by one sorted pass and no text is moved twice.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("key")
    )
    n, top = docs.agg(F.count("*"), F.max("key")).first()
    if not n:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")
    # About a thousand rows a range, and at most some 20,000 ranges: that many numbers go to the driver.
    every = max(1000, n // _BUCKETS)
    picked = docs.select("key").distinct().filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect()
    ends = np.array(sorted({r.key for r in picked} | {top}), np.int64)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("role", T.IntegerType())])))
    def places(key: pd.Series) -> pd.Series:
        keys = key.to_numpy()
        at = np.searchsorted(ends, keys)
        end = ends[at] == keys
        above = np.where(at + 1 < len(ends), at + 1, 0)  # above the last range comes the first one, after its rows
        role = np.where(at + 1 < len(ends), 1, 2)
        return pd.Series([
            [{"bucket": b, "role": 0}] + ([{"bucket": a, "role": r}] if e else [])
            for b, e, a, r in zip(at.tolist(), end.tolist(), above.tolist(), role.tolist())
        ])

    placed = docs.withColumn("place", places("key")).select("doc_id", "text", "key", F.explode("place").alias("place"))
    rows = placed.select("place.bucket", "place.role", "key", "doc_id", "text").repartition("bucket")
    rows = rows.sortWithinPartitions("bucket", "role", F.desc("key"), F.asc_nulls_first("text"))
    return rows.select("bucket", "role", "doc_id", "text").mapInArrow(
        lambda it: _compare(it, plan),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
