"""Near duplicates by a multi-index Hamming join of minhash signatures.

A text's signature has ``4 * chunks`` symbols of 16 bits. Signatures are at a distance of the number of symbols in which they
differ. By the pigeonhole principle two signatures at a distance below ``2 * chunks`` differ in at most one symbol of some chunk
of four; so every text is filed under each chunk with each one of its symbols left out (the allowed chunk error), and all pairs
below that distance meet in a bucket. Pairs that meet are compared on their full shingle sets.

Buckets are never expanded into all pairs. Texts with equal shingle sets are one class. Every class is first compared with
its bucket's smallest class; what these links connect needs no more comparing. Only buckets that still hold several
components are scanned, in tiles of bounded size. A pair across components is looked at in the first bucket only in which it
meets, and if a longer signature allows the required similarity. Large buckets bring the sets along and give only links that
connect components, so that no task's output grows with the pairs. No bucket and no number of partners is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.frames import components, shuffled, small
from ticketlens.llm.shingles import WordHasher, numbers, shingle_sets, signature
from ticketlens.session import materialise

# Rows of a tile, and the members up to which a bucket's pairs leave it unconfirmed; larger buckets bring their sets along.
TILE = 1024
FEW = 64


@dataclass(frozen=True)
class NearDup:
    """``chunks``: index chunks of four symbols. At a similarity of 0.75 a chunk matches with a probability of 0.74, so that ten
    chunks miss a pair once in 650,000. ``screen``: symbols of the longer signature that pairs across components must pass; a
    pair at the threshold fails it by more than five standard deviations only."""

    words: int = 5
    percent: int = 75
    chunks: int = 10
    screen: int = 256

    def least_equal(self, symbols: int, deviations: float) -> int:
        share = self.percent / 100
        return max(0, math.floor(symbols * share - deviations * math.sqrt(symbols * share * (1 - share))))


def _sketch(batches: Iterator[pa.RecordBatch], plan: NearDup) -> Iterator[pa.RecordBatch]:
    hasher, factors = WordHasher(lower=True), numbers(4 * plan.chunks, 77) | np.uint64(1)
    for batch in batches:
        sizes, ids, chunks = [], [], []
        for shingles in shingle_sets(batch.column("text"), hasher, plan.words):
            sizes.append(len(shingles))
            ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            chunks.append(signature(shingles, factors).view(np.int64))
        values = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
        offsets = np.arange(0, len(values) + 1, plan.chunks, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
             pa.ListArray.from_arrays(offsets, values)],
            ["doc_id", "text_hash", "n_shingles", "set_id", "chunks"],
        )


def _sets(batches: Iterator[pa.RecordBatch], plan: NearDup) -> Iterator[pa.RecordBatch]:
    hasher, factors = WordHasher(lower=True), numbers(plan.screen, 1234) | np.uint64(1)
    for batch in batches:
        sets, screens, offsets = [], [], [0]
        for shingles in shingle_sets(batch.column("text"), hasher, plan.words):
            sets.append(shingles.tobytes())
            screens.append(signature(shingles, factors, np.uint8).tobytes())
            offsets.append(len(shingles))
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), pa.array(sets, pa.binary()), pa.array(screens, pa.binary())], ["cid", "shingles", "screen"]
        )


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct hashes reach the similarity, in whole numbers."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (n + m - common)


def _confirm(batches: Iterator[pa.RecordBatch], plan: NearDup) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = [
            _similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), plan.percent)
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _scan_tile(rows: pa.Table, plan: NearDup) -> list[tuple[int, int, bool]]:
    """Pairs across components of one tile pair. If the rows bring their sets, links that connect components are confirmed here;
    else pairs that pass the longer signature leave unconfirmed."""
    slot, i, j = (rows.column(c)[0].as_py() for c in ("slot", "i", "j"))
    cid, n, tile = (rows.column(c).to_numpy() for c in ("cid", "n_shingles", "tile"))
    label = rows.column("label").to_numpy().copy()
    if label.min() == label.max():
        return []
    least = plan.least_equal(plan.screen, 5.5)
    symbols = rows.column("chunks").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(len(cid), plan.chunks, 4)
    screen = np.frombuffer(b"".join(rows.column("screen").to_pylist()), np.uint8).reshape(len(cid), plan.screen)
    sets = [None if x is None else np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    left, right = (tile == i).nonzero()[0], (tile == j).nonzero()[0]
    out = []
    for x in left.tolist():
        y = right[right > x] if i == j else right
        y = y[(label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= plan.percent * np.maximum(n[y], n[x]))]
        if len(y):
            y = y[(screen[y] == screen[x]).sum(axis=1) >= least]
        if not len(y):
            continue
        wrong = symbols[y] != symbols[x]
        errors = wrong.sum(axis=2)
        chunk = (errors <= 1).argmax(axis=1)  # the first chunk in which they meet, and its first fitting error
        at = np.arange(len(y))
        error = np.where(errors[at, chunk] == 0, 0, wrong[at, chunk].argmax(axis=1))
        for k in y[chunk * 4 + error == slot].tolist():
            sure = sets[x] is not None
            if sure:
                if label[k] == label[x] or not _similar(sets[x], sets[k], plan.percent):
                    continue
                label[label == label[k]] = label[x]
            out.append((min(cid[x], cid[k]), max(cid[x], cid[k]), sure))
    return out


def _scan(batches: Iterator[pa.RecordBatch], plan: NearDup) -> Iterator[pa.RecordBatch]:
    """All tile pairs of a task; rows arrive sorted by (slot, key, i, j), and tiles are bounded."""
    def found(rows: list[pa.Table]) -> pa.RecordBatch:
        columns = list(zip(*[pair for r in rows for pair in _scan_tile(r, plan)])) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "sure"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not len(rows):
            continue
        keys = [rows.column(c).to_numpy() for c in ("slot", "key", "i", "j")]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        edges = [0, *cuts.tolist()]
        held = rows.slice(edges[-1])
        yield found([rows.slice(s, e - s) for s, e in zip(edges, edges[1:])])
    if held is not None and len(held):
        yield found([held])


def _key(slot: Column) -> Column:
    """A chunk's four symbols without the one that the slot leaves out."""
    masks = F.array(*[F.lit(~(0xFFFF << (16 * j)) if j < 3 else 0xFFFF_FFFF_FFFF).cast("bigint") for j in range(4)])
    return F.get("chunks", F.shiftright(slot, 2)).bitwiseAND(F.get(masks, slot % 4))


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: NearDup, name: str) -> DataFrame:
    """Those of the written ``pairs`` whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = materialise(wanted, f"{name}-wanted")
    sets = sets.select("cid", "shingles").join(small(wanted, wanted.count()), "cid", "left_semi").dropDuplicates(["cid"])
    joined = (
        small(pairs, pairs.count()).join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(shuffled(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))), "b")
    )
    links = joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda it: _confirm(it, plan), "a bigint, b bigint")
    return materialise(links, f"{name}-links")


def near_duplicates(documents: DataFrame, plan: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII blanks, A-Z folded; a text's set holds its distinct runs of ``plan.words`` words, or the whole
    sequence if it is shorter. Ids may be of any type that has an order. Texts whose sets have ``plan.percent`` % of their union in common are linked, and
    component_id is the smallest doc_id that links reach. A null, empty or blank text has an empty set, no link, and its own
    doc_id. Repeated rows are copies of one document and share all answers. A row without doc_id takes part in links but
    names no component; component_id is null if no member has an id, and such rows are kept. An empty table gives no rows.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketch = materialise(
        docs.mapInArrow(
            lambda it: _sketch(it, plan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n_shingles bigint, set_id binary, chunks array<bigint>"
        ),
        "neardup-sketch",
    )
    classes = (
        sketch.filter("n_shingles > 0").groupBy("set_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n_shingles", "chunks")).alias("r"))
        .select("set_id", F.monotonically_increasing_id().alias("cid"), "r.doc_id", "r.text_hash", "r.n_shingles", "r.chunks")
    )
    classes = materialise(classes, "neardup-classes")

    slots = F.explode(F.sequence(F.lit(0), F.lit(4 * plan.chunks - 1)))
    keys = classes.select("cid", "chunks", slots.alias("slot")).select(
        F.col("slot").cast("tinyint").alias("slot"), _key(F.col("slot")).alias("key"), "cid"
    )
    heads = keys.groupBy("slot", "key").agg(F.min("cid").alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = materialise(keys.join(shuffled(heads), ["slot", "key"]), "neardup-members")

    shared = materialise(members.select("cid").distinct(), "neardup-shared")
    n_shared = shared.count()
    wanted = classes.select("cid", "doc_id", "text_hash").join(small(shared, n_shared), "cid", "left_semi")
    wanted = wanted.select("cid", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    found = docs.join(small(wanted, n_shared), docs.doc_id.eqNullSafe(F.col("id")) & (docs.text_hash == F.col("hash")))
    sets = found.select("cid", "text").mapInArrow(lambda it: _sets(it, plan), "cid bigint, shingles binary, screen binary")
    sets = materialise(sets, "neardup-sets")

    stars = members.filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    first = _confirmed(materialise(stars, "neardup-stars"), sets, plan, "neardup-first")
    labels = components(first, "neardup-first")

    labelled = members.select("slot", "key", "cid", "size").join(small(labels.withColumnRenamed("node", "cid"), labels.count()), "cid", "left").select(
        "slot", "key", "cid", "size", F.coalesce("label", "cid").alias("label")
    )
    labelled = materialise(labelled, "neardup-labelled")
    mixed = labelled.groupBy("slot", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    open_ = labelled.join(shuffled(mixed.select("slot", "key")), ["slot", "key"], "left_semi")
    n_tiles = F.ceil(F.col("size") / TILE).cast("int")
    tiled = open_.withColumn("tile", F.pmod(F.xxhash64("cid"), n_tiles).cast("int")).select(
        "slot", "key", "cid", "label", "size", "tile", F.explode(F.sequence(F.lit(0), n_tiles - 1)).alias("other")
    )
    tiled = tiled.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")
    names = ["slot", "key", "i", "j", "tile", "cid", "label", "n_shingles", "chunks", "screen", "shingles"]
    screens = sets.select("cid", "screen").dropDuplicates(["cid"]).join(shuffled(classes.select("cid", "n_shingles", "chunks")), "cid")
    few = tiled.filter(F.col("size") <= FEW).join(shuffled(screens), "cid").withColumn("shingles", F.lit(None).cast("binary"))
    large = materialise(tiled.filter(F.col("size") > FEW).select("cid").distinct(), "neardup-large")
    whole = sets.join(small(large, large.count()), "cid", "left_semi").dropDuplicates(["cid"])
    many = tiled.filter(F.col("size") > FEW).join(shuffled(whole.join(shuffled(classes.select("cid", "n_shingles", "chunks")), "cid")), "cid")
    rows = few.select(names).union(many.select(names)).repartition("slot", "key", "i", "j")
    rows = rows.sortWithinPartitions("slot", "key", "i", "j", "cid")
    candidates = materialise(rows.mapInArrow(lambda it: _scan(it, plan), "a bigint, b bigint, sure boolean"), "neardup-second")
    unsure = materialise(candidates.filter("not sure").select("a", "b").distinct(), "neardup-unsure")
    second = _confirmed(unsure, sets, plan, "neardup-second")
    second = second.union(candidates.filter("sure").select("a", "b"))

    final = components(first.union(second), "neardup-all")
    named = classes.select("set_id", "cid", "doc_id").join(small(final.withColumnRenamed("node", "cid"), final.count()), "cid", "left").select(
        "set_id", "doc_id", F.coalesce("label", "cid").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    answer = named.select("set_id", "label").join(shuffled(smallest), "label").select("set_id", "component_id")
    out = sketch.select("doc_id", "n_shingles", "set_id").join(shuffled(answer), "set_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def keep_one(documents: DataFrame, plan: NearDup = NearDup()) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, with all their columns: of each group the row with the smallest doc_id
    (each of its copies, if a row is repeated)."""
    dropped = near_duplicates(documents, plan).filter("not kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    dropped = materialise(dropped, "neardup-dropped")
    return documents.join(small(dropped, dropped.count()), documents["doc_id"].eqNullSafe(dropped["dropped_id"]), "left_anti")
