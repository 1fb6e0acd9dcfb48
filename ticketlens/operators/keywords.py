"""Keyword tables of any size against texts, by an index of q-grams.

A text contains a keyword only if it contains the keyword's q-grams. So every keyword is filed under one of them, the one that the fewest of
the texts hold, and a text is looked up by its distinct q-grams: an equi-join, after which only the few keywords filed under a gram of
the text are compared with it. Keywords shorter than ``q`` are filed under themselves, and texts give grams of these lengths too. Grams that no
keyword is filed under are dropped within the row by a bit set of fixed size, before rows are made: each of the others takes its row along.
They are hashed by numpy for many texts at once and become strings only if their bits are set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.session import materialise

# One text in so many tells how common a gram is. That decides only where a keyword is filed, never what matches.
_FREQUENCY_SHARE = 64
_BITS, _BIT_HASHES = 21, 3  # two to this power, of a hash of 64 bits
_CHARACTERS = 1 << 20  # that are hashed at once; a longer text is hashed alone


def grams(text: Column, q: int) -> Column:
    """The distinct runs of ``q`` characters of a text; the empty run for ``q`` 0."""
    if q == 0:
        return F.array(F.lit(""))
    # One pass: at every character, what follows it is looked at and the character itself is taken.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1)))


def gram_index(keywords: DataFrame, texts: DataFrame, q: int, text_col: str) -> DataFrame:
    """(keyword, topic, needle, gram) with the gram that each keyword is filed under. Null keywords are left out, equal rows count once."""
    lowered = keywords.select("keyword", "topic", F.lower("keyword").alias("needle")).filter("needle IS NOT NULL").distinct()
    own = F.when(F.length("needle") < q, F.array("needle")).otherwise(grams(F.col("needle"), q))
    choices = materialise(lowered.select("needle", F.explode(own).alias("gram")).distinct(), "keyword-grams")
    few = texts.filter(F.pmod(F.xxhash64(text_col), F.lit(_FREQUENCY_SHARE)) == 0)
    seen = few.select(F.explode(grams(F.lower(tx.fill_text(F.col(text_col))), q)).alias("gram"))
    common = seen.join(choices.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    best = choices.join(common, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return materialise(lowered.join(best.select("needle", F.col("best.gram").alias("gram")), "needle"), "keyword-index")


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` characters."""
    out = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(_BITS * i)) & np.uint64((1 << _BITS) - 1) for i in range(_BIT_HASHES)]


def gram_bits(index: DataFrame) -> np.ndarray:
    """The grams of ``index`` as bits of fixed size, in words of 64: all of them, and by chance others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _BITS, bool)
        for batch in batches:
            found = batch.column("gram").to_pylist()
            sizes = np.array([len(g) for g in found], np.int64)
            codes, starts = _codes(found), np.cumsum(sizes) - sizes
            for n in set(sizes[sizes > 0].tolist()):
                for slot in _slots(_hashes(codes, n)[starts[sizes == n]]):
                    bits[slot] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], ["word", "bits"])

    words = np.zeros(1 << (_BITS - 6), np.int64)
    for row in index.select("gram").distinct().mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[row["word"]] = row["bits"]
    return words


def _held_grams(texts: list[str], lengths: list[int], bits: np.ndarray) -> list[list[str]]:
    """The distinct runs of these lengths of each text that the bits may hold."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes, ends = _codes(texts), np.cumsum(sizes)
    out: list[dict[str, None]] = [{} for _ in texts]
    for n in lengths:
        if n == 0:
            for found in out:
                found[""] = None
            continue
        hashes = _hashes(codes, n)
        at = np.arange(len(hashes))
        for i in range(_BIT_HASHES):
            slot = _slots(hashes[at])[i]
            at = at[bits[slot] != 0]
        row = np.searchsorted(ends, at, side="right")
        row, at = row[at + n <= ends[row]], at[at + n <= ends[row]]
        for r, a in zip(row.tolist(), (at - ends[row] + sizes[row]).tolist()):
            out[r][texts[r][a : a + n]] = None
    return [list(found) for found in out]


def held_grams(text: Column, lengths: list[int], words: np.ndarray) -> Column:
    """The distinct runs of these lengths of a text that the bits ``words`` may hold; in Arrow batches, some texts at once."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        for batch in batches:
            texts, out, first, size = batch.tolist(), [], 0, 0
            for i, text in enumerate(texts):
                if size and size + len(text) > _CHARACTERS:
                    out += _held_grams(texts[first:i], lengths, bits)
                    first, size = i, 0
                size += len(text)
            yield pd.Series(out + _held_grams(texts[first:], lengths, bits), dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


def keyword_table_matches(df: DataFrame, keywords: DataFrame, text_col: str = "text", q: int = 5) -> DataFrame:
    """Each row of ``df`` once per row of ``keywords`` (keyword, topic) whose keyword its text contains, ignoring case, with ``keyword`` and ``topic``.

    A null text is empty and contains only an empty keyword, which every text contains. Repeated rows of ``df`` each match; repeated
    rows of ``keywords`` count once. ``df`` must not have columns of the names ``keyword`` and ``topic``. Empty tables give no rows.
    """
    index = gram_index(keywords, df, q, text_col)
    short = sorted(r.n for r in index.filter(F.length("needle") < q).select(F.length("needle").alias("n")).distinct().collect())
    words = gram_bits(index)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.lower(tx.fill_text(F.col(f"`{text_col}`"))).alias("_text"))
    asked = held_grams(F.col("_text"), [*short, q], words)
    # The text is moved once: it is lowered again behind the join.
    looked_up = rows.select("_row", F.explode(asked).alias("gram"))
    text = F.lower(tx.fill_text(F.col("_row").getField(text_col)))
    return looked_up.join(index, "gram").filter(F.contains(text, "needle")).select("_row.*", "topic", "keyword")
