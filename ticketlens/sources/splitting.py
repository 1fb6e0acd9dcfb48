"""Splitting CSV files with quoted line breaks and whole-document JSON files among many tasks.

A record cannot be cut at any line break: whether one ends a record depends on all that stands before it. So every block of a file (what
one task reads at a time) is read twice. First, for each state in which it may begin (outside or inside of quotes; for JSON also how
deep), the state in which it ends is found. These few rows, one per block, give the true state at each block's begin by running through
the blocks of a file. Then every block is cut into records; what a record has in other blocks, its fragments, is joined.

Blocks are read by Spark's own text reader, so that files may lie in any store; it splits at a separator, which is the line break for
CSV and the closing brace for JSON (a document may be a single line). Nothing but the header goes to the driver.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.session import materialise

_FEW_BLOCKS = 200_000  # rows of under 200 bytes; beyond it the blocks' states are joined by a shuffle
_FLUSH = 1 << 22


class Machine(Protocol):
    """Reads the pieces between separators. A state is (mode, depth); blocks may begin in each of ``modes``, at any depth."""

    separator: str
    modes: tuple[int, ...]

    def advance(self, piece: str, mode: int, depth: int) -> tuple[int, int]: ...

    def ends_record(self, mode: int, depth: int) -> bool: ...


class CsvMachine:
    """Mode 0: a record begins; mode 1: within quotes. Quotes count at a field's begin only; a doubled one stands for itself."""

    separator, modes = "\n", (0, 1)

    def advance(self, piece: str, mode: int, depth: int) -> tuple[int, int]:
        if '"' not in piece:
            return mode, depth
        at, inside = 0, mode == 1
        while True:
            if inside:
                at = piece.find('"', at)
                if at < 0:
                    return 1, depth
                if piece.startswith('"', at + 1):
                    at += 2
                    continue
                inside, at = False, at + 1
            elif piece.startswith('"', at):
                inside, at = True, at + 1
                continue
            at = piece.find(",", at) + 1
            if not at:
                return 0, depth

    def ends_record(self, mode: int, depth: int) -> bool:
        return mode == 0


_JSON_SIGNS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)
_STRING_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)', re.DOTALL)
_DEEP = 1 << 40  # stands for the unknown depth at which a block begins


class JsonMachine:
    """Mode 1: within a string. A record of a document that is an array of objects ends where the depth falls to one. A document that is one
    object is read as an array of it."""

    separator, modes = "}", (0, 1)

    def advance(self, piece: str, mode: int, depth: int) -> tuple[int, int]:
        at = 0
        if mode == 1:
            rest = _STRING_REST.match(piece)
            if not rest[0].endswith('"') or _open(rest[0], False):
                return 1, depth
            at = rest.end()
        for m in _JSON_SIGNS.finditer(piece, at):
            sign = m[0][0]
            if sign == '"':
                if _open(m[0], True):
                    return 1, depth
            else:
                depth += (1 if depth or sign == "[" else 2) if sign in "{[" else -1
        return 0, depth - 1  # the separator closes an object

    def ends_record(self, mode: int, depth: int) -> bool:
        return mode == 0 and depth == 1


def _open(string: str, begun: bool) -> bool:
    """Whether a string (with its opening quote if ``begun``) has no closing quote."""
    body = string[1:] if begun else string
    if not body.endswith('"'):
        return True
    slashes = len(body) - 1 - len(body[:-1].rstrip("\\"))
    return slashes % 2 == 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Pieces with their block, as long as neighbouring rows share it; a block may come in several turns."""
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or files[i] != files[at] or starts[i] != starts[at]:
                yield (files[at], starts[at]), values[at:i]
                at = i


def _pieces(spark: SparkSession, path: str, machine: Machine) -> DataFrame:
    text = spark.read.option("lineSep", machine.separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def block_states(pieces: DataFrame, machine: Machine) -> DataFrame:
    """(file, block, mode, depth) at the begin of every block, one row each."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, base = None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "modes": [m for m, _ in states], "depths": [d - base for _, d in states]}], schema=kinds)

        kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("modes", pa.list_(pa.int64())), ("depths", pa.list_(pa.int64()))])
        for key, values in _blocks(batches):
            if key != now:
                if now is not None:
                    yield row()
                base = _DEEP if key[1] else 0
                now, states = key, [(m, base) for m in machine.modes]
            for value in values:
                states = [machine.advance(value, *s) for s in states]
        if now is not None:
            yield row()

    def begins(key: tuple, rows: pa.Table) -> pa.Table:
        """The states of one file's blocks, by running through them in order."""
        out, mode, depth = [], 0, 0
        for r in sorted(rows.to_pylist(), key=lambda r: r["block"]):
            out.append({"file": r["file"], "block": r["block"], "mode": mode, "depth": depth})
            at = machine.modes.index(mode)
            mode, depth = r["modes"][at], depth + r["depths"][at]
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("mode", pa.int64()), ("depth", pa.int64())]))

    summary = pieces.mapInArrow(ends, "file string, block bigint, modes array<bigint>, depths array<bigint>")
    return summary.groupBy("file").applyInArrow(begins, "file string, block bigint, mode bigint, depth bigint")


def records(spark: SparkSession, path: str, machine: Machine, tidy: Callable[[str], str] = lambda r: r) -> DataFrame:
    """(file, block, place, record) of every record, with the separators within it; place numbers a block's records from 0.

    ``tidy`` is applied to each whole record. Files are read twice; only fragments, at most two per block, are shuffled.
    """
    pieces = _pieces(spark, path, machine)
    states = materialise(block_states(pieces, machine), "block-states")
    if states.count() <= _FEW_BLOCKS:
        known = pieces.join(F.broadcast(states), ["file", "block"])
    else:
        numbered = pieces.withColumn("line", F.monotonically_increasing_id())
        known = numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line").drop("line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("part", pa.string()), ("record", pa.string())])
        out: list[dict] = []
        size = 0
        now, mode, depth, held, head, place = None, 0, 0, [], False, 0

        def emit(part: str) -> None:
            nonlocal held, size, place
            text = machine.separator.join(held)
            text = tidy(text) if part == "whole" else text
            out.append({"file": now[0], "block": now[1], "place": place, "part": part, "record": text})
            size += len(text)
            held, place = [], place + 1

        def finish() -> None:
            if now is not None and held:
                emit("middle" if head else "tail")

        for batch in batches:
            begin = {(f, b): (m, d) for f, b, m, d in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "mode", "depth")))}
            for key, values in _blocks(iter([batch.select(["file", "block", "value"])])):
                if key != now:
                    finish()
                    now, (mode, depth), held, place = key, begin[key], [], 0
                    head = not (mode == 0 and depth == 0) and not machine.ends_record(mode, depth)
                for value in values:
                    held.append(value)
                    mode, depth = machine.advance(value, mode, depth)
                    if machine.ends_record(mode, depth):
                        emit("head" if head else "whole")
                        head = False
            if size > _FLUSH:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out, size = [], 0
        finish()
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    parts = materialise(known.select("file", "block", "value", "mode", "depth").mapInArrow(cut, "file string, block bigint, place bigint, part string, record string"), "records")
    whole = parts.filter("part = 'whole'").select("file", "block", "place", "record")
    # A broken record begins with a tail and goes on through middles to a head; its number is that of the tails so far.
    order = Window.partitionBy("file").orderBy("block", "place")
    broken = parts.filter("part <> 'whole'").withColumn("chain", F.count_if(F.col("part") == "tail").over(order))
    pieced = broken.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "place", "record"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["record"]), machine.separator)
    made = F.udf(tidy, "string", useArrow=False)(text)  # a record or two for each block
    joined = pieced.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"), made.alias("record"))
    return whole.unionByName(joined)


def _no_return(record: str) -> str:
    return record.removesuffix("\r")


def csv_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's names and the other records (one column ``record``) of CSV files, which must all have one header."""
    found = records(spark, path, CsvMachine(), _no_return)
    firsts = Window.partitionBy("file").orderBy("block", "place")
    heads = found.filter("block = 0 AND record <> ''").withColumn("n", F.row_number().over(firsts)).filter("n = 1")
    heads = materialise(heads.select("file", "block", "place", F.regexp_replace("record", "^\ufeff", "").alias("head")), "csv-heads")
    distinct = [r.head for r in heads.select("head").distinct().limit(2).collect()]
    if len(distinct) > 1:
        raise ValueError(f"the files have different headers: {distinct}")
    if not distinct:
        return [], found.select("record").limit(0)
    rows = found.join(heads.select("file", "block", "place"), ["file", "block", "place"], "left_anti").filter("record <> ''")
    return next(csv.reader([distinct[0]])), rows.select("record")


def _object(record: str) -> str:
    """An element of a document's array without what stands before it: the array's begin, commas and blanks."""
    return record[record.index("{") :] + "}" if "{" in record else ""


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The objects (one column ``record``) of JSON files that hold an array of objects each."""
    return records(spark, path, JsonMachine(), _object).filter("record <> ''").select("record")
