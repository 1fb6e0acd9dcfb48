"""Token counts per field and section of a document by offsets.

The fields of a document are joined and encoded once, as a whole, since tokens may cross the borders of parts. A byte-level
token covers as many bytes as its entry has, so running sums give every token's span. Tokens are joined to the sections by a sorted
interval search, and a token that crosses a border is allocated by a stated rule.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most")


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE as ranks in a tiktoken file, and its splitting pattern."""

    path: str
    pattern: str


@functools.lru_cache(4)
def load(vocabulary: Vocabulary) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder, and how many bytes each token covers; once for each Python worker."""
    with open(vocabulary.path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("given", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def allocate(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each part: allocated by the rule, crossing a border of the part, and in shares of their bytes.

    ``ends``: byte at which each token ends. ``borders``: the bytes at which the parts begin, ascending, then the end of the last;
    parts follow each other without gaps and may be empty. ``first`` gives a crossing token to the part with its first byte, ``most``
    to the part with most of its bytes, the earliest among equals.
    """
    n = len(borders) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    a = np.searchsorted(borders, starts, "right") - 1
    b = np.searchsorted(borders, ends, "left") - 1
    inside = a == b
    counts = np.bincount(a[inside], minlength=n)
    crossing, share = np.zeros(n, np.int64), counts.astype(np.float64)
    for s, e, i, j in zip(*(x[~inside].tolist() for x in (starts, ends, a, b))):
        overlap = np.minimum(borders[i + 1 : j + 2], e) - np.maximum(borders[i : j + 1], s)
        share[i : j + 1] += overlap / (e - s)
        crossing[i : j + 1] += overlap > 0
        counts[i + (0 if rule == "first" else int(overlap.argmax()))] += 1
    return counts, crossing, share


def parts_of(values: Sequence[str], lines: bool) -> list[tuple[int, int, str]]:
    """(field, section, piece) in the order of the joined document. A field is followed by a line break, the last one is not; with
    ``lines`` each line with its break is a section, else each field is. The break behind a field is a part of field -1."""
    out = []
    for i, value in enumerate(values):
        pieces = [p + "\n" for p in value.split("\n")] if lines else [value]
        if lines:
            pieces[-1] = pieces[-1][:-1]
            if len(pieces) > 1 and not pieces[-1]:
                pieces.pop()
        out += [(i, k, p) for k, p in enumerate(pieces)]
        if i + 1 < len(values):
            out.append((-1, i, "\n"))
    return out


def count_tokens(
    documents: DataFrame, vocabulary: Callable[[], Vocabulary] | Vocabulary, fields: Sequence[str] = ("text",), lines: bool = True,
    rule: str = "most", doc_id: str = "doc_id",
) -> DataFrame:
    """Per row of ``documents`` and section: doc_id, field, section, start, end, n_tokens, n_crossing, token_share.

    ``start`` and ``end`` are code points of the joined document. ``n_tokens`` allocates every token to one part by ``rule``, so that a
    document's parts add up to its tokens; ``token_share`` splits crossing tokens by bytes and adds up likewise. ``n_crossing``
    counts the tokens that the part shares with others. Field ``(between)`` has the line breaks between fields, where there are
    several. A null or empty field is one empty section. Repeated rows are counted each; other columns are ignored; an
    empty table gives no rows. ``vocabulary`` may be a function, called on the executors.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
        ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("token_share", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = load(vocabulary() if callable(vocabulary) else vocabulary)
        for batch in batches:
            ids, field, section, start, end, counts, crossing, share = ([] for _ in range(8))
            for doc, *values in zip(batch.column("doc_id").to_pylist(), *(batch.column(f"f{i}") for i in range(len(names)))):
                parts = parts_of([v.as_py() or "" for v in values], lines)
                text = "".join([p for *_, p in parts])
                borders = np.cumsum([0, *[len(p.encode()) for *_, p in parts]])
                tokens = np.asarray(encoding.encode_ordinary(text), np.int64)
                got = allocate(np.cumsum(sizes[tokens]), borders, rule)
                places = np.cumsum([0, *[len(p) for *_, p in parts]]).tolist()
                ids += [doc] * len(parts)
                field += ["(between)" if f < 0 else names[f] for f, *_ in parts]
                section += [k for _, k, _ in parts]
                start += places[:-1]
                end += places[1:]
                for out, values_ in zip((counts, crossing, share), got):
                    out += values_.tolist()
            columns = (ids, field, section, start, end, counts, crossing, share)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    narrow = documents.select(F.col(doc_id).alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(names)])
    return narrow.mapInArrow(
        run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, field string, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint, token_share double"
    )
