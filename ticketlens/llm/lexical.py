"""Ranked lexical search over a length-stratified index.

A document's normaliser ``m`` depends on its length alone, so documents with equal ``m`` form a stratum, in which a term's share of
the score depends on its frequency alone. The index deals documents out to shards of bounded size by a hash, numbers a shard's documents stratum by stratum, and keeps one row per shard and term: its postings by stratum and, within it, by falling
frequency. The first posting of a stratum gives the term's largest share there, and the sum over an item's terms is the bound of the
stratum. Strata are visited by falling bound, in growing batches, until the next bound is below the k-th best score; the share of a
term is computed once for each normaliser and frequency. Each shard gives its k best documents per item, and these are ranked.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ticketlens.llm.shingles import text_bytes
from ticketlens.session import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


@dataclass(frozen=True)
class LexicalPlan:
    """``k``: documents per item. ``shard``: expected bytes of a shard's texts, ``block``: expected item terms that meet a shard at once;
    both bound a task's memory and change no result. ``growth``: how much larger each batch of strata is than all before it."""

    k: int = 50
    shard: int = 8_000_000
    block: int = 200_000
    growth: int = 4


@dataclass(frozen=True)
class LexicalIndex:
    """``rows``: one header per shard (term null) with the documents' ids and normalisers by position, and one row per shard and term with
    positions and frequencies. ``documents``: those with a term, ``terms``: all their terms with repeats."""

    rows: DataFrame
    documents: int
    terms: int
    shards: int


def folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def term_frequencies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (distinct ones, joined by blanks), tfs (their numbers as 32-bit integers) and place (a hash) of every
    row with at least one term. Equal rows of a task are told apart in their hashes by a running number, so that copies spread."""
    narrow = documents.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: Counter[bytes] = Counter()
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            ends = offsets.tolist()
            rows: list[tuple[int, bytes, bytes, int]] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends, ends[1:]):
                raw = data[a:b].tobytes()
                words = raw.translate(_TABLE).split()
                found = Counter(words)
                row = hashlib.blake2b(repr(doc).encode() + b" " + raw, digest_size=16).digest()
                copies[row] += bool(words)
                place = hashlib.blake2b(row + copies[row].to_bytes(8, "big"), digest_size=8).digest()
                rows.append((len(words), b" ".join(found), np.fromiter(found.values(), np.int32, len(found)).tobytes(), int.from_bytes(place, "big", signed=True)))
            n, terms, tfs, place = zip(*rows) if rows else ((),) * 4
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.binary()), pa.array(place, pa.int64())],
                ["doc_id", "n", "terms", "tfs", "place"],
            )
            yield out.filter(pa.compute.greater(out.column("n"), 0))

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n bigint, terms string, tfs binary, place bigint")


def build_index(documents: DataFrame, plan: LexicalPlan = LexicalPlan(), doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """The index over all rows of ``documents``, written to the shared folder.

    Terms are the maximal runs of letters and digits of ASCII and of all other characters beyond ASCII, A-Z folded. Null, empty and
    termless texts are no documents. Repeated rows are documents of their own; ids may be null or repeated. Other columns are ignored.
    """
    body = F.col(f"`{text}`")
    sizes = F.count_if(body.rlike(TERM)).alias("n"), F.sum(F.regexp_count(body, F.lit(TERM)).cast("bigint")).alias("terms"), F.sum(F.octet_length(body)).alias("bytes")
    total = documents.agg(*sizes).first()
    n_docs, n_terms, shards = total.n, total.terms or 0, max(1, -(-(total.bytes or 0) // plan.shard))
    counted = term_frequencies(documents, doc_id, text)
    m = F.lit(50) + F.expr(f"(50 * n * {n_docs}) div {max(1, n_terms)}")
    dealt = counted.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "doc_id", m.alias("m"), "terms", "tfs")
    id_type = counted.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
        T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("ms", T.ArrayType(T.LongType())),
    ])
    rows = dealt.groupBy("shard").applyInArrow(_inverted, schema)
    return LexicalIndex(materialise(rows, "lexical-index"), n_docs, n_terms, shards)


def _inverted(rows: pa.Table) -> pa.Table:
    """Header and term rows of one shard."""
    rows = rows.take(pa.compute.sort_indices(rows, [("m", "ascending")])).combine_chunks()
    m, ids = rows.column("m").combine_chunks(), rows.column("doc_id").combine_chunks()
    lists = pa.compute.split_pattern(rows.column("terms").combine_chunks(), " ")
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    terms, names = coded.indices.to_numpy(), coded.dictionary
    tfs = np.frombuffer(b"".join(rows.column("tfs").to_pylist()), np.int32)
    docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    stratum = np.cumsum(np.concatenate(([0], np.diff(m.to_numpy()) != 0)))[docs] if len(sizes) else docs
    order = np.lexsort((docs, -tfs, stratum, terms))
    df = np.bincount(terms, minlength=len(names))
    cuts = np.concatenate(([0], np.cumsum(df))).astype(np.int32)
    n = len(names)
    first = pa.array([True] + [False] * n)

    def column(body: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([pa.nulls(1, kind), body.cast(kind)])

    def lists_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return column(pa.ListArray.from_arrays(pa.array(cuts), pa.array(values[order], kind)), pa.list_(kind))

    def header(values: pa.Array) -> pa.Array:
        whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.concat_arrays([whole, pa.nulls(n, whole.type)])

    shard = rows.column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array(np.full(len(first), shard, np.int32)), "term": column(names, pa.string()), "df": column(pa.array(df, pa.int64()), pa.int64()),
        "docs": lists_of(docs, pa.int32()), "tfs": lists_of(tfs, pa.int32()), "ids": header(ids), "ms": header(m),
    })


def weighted_terms(index: LexicalIndex, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term, w for every term of an item that some document holds and whose weight is not 0; each term once per item id."""
    terms = F.array_distinct(F.regexp_extract_all(folded(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(TERM), F.lit(0)))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(terms).alias("term")).distinct()
    df = index.rows.select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")
    return asked.join(df, "term").select("item_id", "term", F.floor(1000 * F.log(ratio)).cast("bigint").alias("w")).filter("w > 0")


class _Shard:
    """One shard's postings of the asked terms as flat arrays."""

    def __init__(self, rows: pa.Table):
        header = rows.filter(pa.compute.is_null(rows.column("term")))
        rows = rows.filter(pa.compute.is_valid(rows.column("term"))).combine_chunks()
        self.ids = header.column("ids").combine_chunks().flatten()
        m = header.column("ms").combine_chunks().flatten().to_numpy()
        at = pa.compute.sort_indices(self.ids, null_placement="at_end").to_numpy()
        self.id_rank = np.empty(len(at), np.int64)
        self.id_rank[at] = np.arange(len(at))
        self.stratum = np.cumsum(np.concatenate(([0], np.diff(m) != 0)))
        self.size = np.bincount(self.stratum)
        self.place = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
        lists = rows.column("docs").combine_chunks()
        self.cuts = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy())))) if len(rows) else np.zeros(1, np.int64)
        self.docs = lists.flatten().to_numpy()
        tfs = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        self.strata = self.stratum[self.docs]
        # A share is computed once for each stratum and frequency.
        pairs, which = np.unique(np.stack([m[self.docs], tfs]), axis=1, return_inverse=True) if len(tfs) else (np.zeros((2, 0), np.int64), tfs)
        self.share = (1_000_000_000 * pairs[1] // (1000 * pairs[1] + 20 * pairs[0]))[which.reshape(-1)]
        row = np.repeat(np.arange(len(rows)), np.diff(self.cuts))
        self.heads = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(self.strata) != 0)))) if len(tfs) else tfs
        self.head_cuts = np.searchsorted(self.heads, self.cuts)

    def best(self, terms: list[tuple[int, int]], plan: LexicalPlan) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best documents for (row, weight) pairs."""
        bounds = np.zeros(len(self.size), np.int64)
        for row, w in terms:
            heads = self.heads[self.head_cuts[row] : self.head_cuts[row + 1]]
            bounds[self.strata[heads]] += w * self.share[heads]
        order = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds)]
        reach = np.cumsum(self.size[order])
        top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, wanted = 0, plan.k
        while at < len(order):
            if len(top) == plan.k and bounds[order[at]] < scores[-1]:
                break
            to = min(len(order), max(at + 1, int(np.searchsorted(reach, wanted)) + 1))
            open_ = np.zeros(len(self.size), bool)
            open_[order[at:to]] = True
            total = np.zeros(len(self.stratum), np.int64)
            for row, w in terms:
                a, b = self.cuts[row], self.cuts[row + 1]
                seen = open_[self.strata[a:b]]
                total[self.docs[a:b][seen]] += w * self.share[a:b][seen]
            new = np.flatnonzero(total)
            if len(top) == plan.k:
                new = new[total[new] >= scores[-1]]
            top, scores = np.concatenate([top, new]), np.concatenate([scores, total[new]])
            keep = np.lexsort((self.id_rank[top], -scores))[: plan.k]
            top, scores = top[keep], scores[keep]
            at, wanted = to, max(plan.k, int(reach[to - 1])) * plan.growth
        return top, scores


def _answers(key: tuple, rows: pa.Table, asked: pa.Table, plan: LexicalPlan, kinds: tuple[pa.DataType, pa.DataType]) -> pa.Table:
    """The best documents of one shard for each item of one block."""
    items: dict[object, list[tuple[int, int]]] = {}
    found: list[tuple[object, np.ndarray, np.ndarray]] = []
    if len(rows) and len(asked):
        shard = _Shard(rows)
        for item, term, w in zip(*(asked.column(c).to_pylist() for c in ("item_id", "term", "w"))):
            if term in shard.place:
                items.setdefault(item, []).append((shard.place[term], w))
        found = [(item, *shard.best(terms, plan)) for item, terms in items.items()]
    names = [item for item, top, _ in found for _ in range(len(top))]
    ids = shard.ids.take(pa.array(np.concatenate([top for _, top, _ in found]))) if found else pa.nulls(0, kinds[1])
    scores = np.concatenate([s for *_, s in found]) if found else np.zeros(0, np.int64)
    return pa.table({"item_id": pa.array(names, kinds[0]), "doc_id": ids.cast(kinds[1]), "score": pa.array(scores, pa.int64())})


def search(index: LexicalIndex, items: DataFrame, plan: LexicalPlan = LexicalPlan(), item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the ``plan.k`` best documents with a score above 0 for each item, by score and then id, null last.

    Items without a term that a document holds give no rows, so do an empty table of items or documents. Rows with one item id are one
    item with the terms of all. Repeated documents are ranked side by side. Other columns are ignored. Items meet the shards in blocks.
    """
    weights = materialise(weighted_terms(index, items, item_id, text), "lexical-items")
    blocks = max(1, -(-weights.count() // plan.block))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    asked = weights.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    wanted = weights.select("term").distinct()
    postings = index.rows.filter("term IS NOT NULL").join(wanted, "term", "left_semi").unionByName(index.rows.filter("term IS NULL"))
    postings = postings.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    item_field, id_field = weights.schema["item_id"], T.StructField("doc_id", index.rows.schema["ids"].dataType.elementType)
    schema = T.StructType([T.StructField("item_id", item_field.dataType), id_field, T.StructField("score", T.LongType())])
    run = functools.partial(_answers, plan=plan, kinds=(to_arrow_type(item_field.dataType), to_arrow_type(id_field.dataType)))

    def answers(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        return run(key, rows, asked)

    local = postings.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(answers, schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= plan.k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(t, '{TERM}') AS words FROM t),
d AS (SELECT row, doc_id, len(words) AS n, words FROM w WHERE len(words) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY row, term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM i JOIN f USING (term), g),
s AS (
  SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM x JOIN p USING (term) JOIN d USING (row), g GROUP BY item_id, row, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
