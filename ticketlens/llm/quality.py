"""Quality rules per document, and verdicts per host that are joined back to its documents.

Every document is measured once, in a task. A host's share of documents that break a rule is shrunk towards the share over all
hosts: a Beta prior is fitted to the hosts' shares by the method of moments, so that a host with few documents is judged
mostly by the prior. A host is bad if its share exceeds the prior's mean by a given factor with a high posterior probability, by the
normal approximation of the Beta posterior. Documents of a bad host are held to stricter rules; a document without any
fault is kept whatever its host.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.frames import fresh, small
from ticketlens.llm.shingles import WordHasher, text_bytes, windows
from ticketlens.session import materialise

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityRules:
    """``window``: words of a repeated window. A document fails with fewer than ``min_words`` words or more than ``max_repeat``
    percent repeated words. The other limits (percent) are faults that count for the host and, in a bad host, for the
    document: symbols per word, repeated lines among all lines, mean word length. A host is bad if its shrunk share less
    ``host_sure`` standard deviations of its posterior (1.645: 95 %) is above ``host_factor`` times the prior's mean."""

    window: int = 8
    min_words: int = 20
    max_repeat: int = 30
    max_symbols: int = 10
    max_dup_lines: int = 30
    word_length: tuple[int, int] = (2, 15)
    host_factor: float = 1.2
    host_sure: float = 1.645

    def failed(self) -> Column:
        return (F.col("n_words") < self.min_words) | (100 * F.col("n_repeat_words") > self.max_repeat * F.col("n_words"))

    def faulty(self) -> Column:
        low, high = self.word_length
        return (
            self.failed() | (100 * F.col("n_symbols") > self.max_symbols * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > self.max_dup_lines * F.col("n_lines"))
            | (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
        )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(hashes: np.ndarray, size: int) -> int:
    """Words covered by windows that occur more than once."""
    runs = windows(hashes, size)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1] > 0))


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def _measure(column: pa.Array, hasher: WordHasher, size: int) -> list[pa.Array]:
    offsets, data = text_bytes(column)
    out = np.zeros((len(MEASURES), len(column)), np.int64)
    row = 0
    for hashes, begin in hasher.texts(column):
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            raw = data[offsets[row] : offsets[row + 1]].tobytes()
            words = raw.translate(None, _BLANKS)
            continuation = int(np.count_nonzero((np.frombuffer(words, np.uint8) & 0xC0) == 0x80))
            out[:, row] = (
                b - a, len(words) - continuation, len(raw) - len(raw.translate(None, _SYMBOLS)), *_lines(raw), _repeated(hashes[a:b], size)
            )
            row += 1
    return [pa.array(x) for x in out]


def measure(documents: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``documents`` with the measures of each text beside its columns, and the names that the measures got (others than
    their own if the table has such columns)."""
    names = {m: fresh(f"_{m}", documents.columns) for m in MEASURES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for batch in batches:
            values = _measure(batch.column(text), hasher, rules.window)
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], [*batch.schema.names, *names.values()])

    fields = [T.StructField(name, T.LongType()) for name in names.values()]
    return documents.mapInArrow(run, T.StructType(documents.schema.fields + fields)), names


def host_rates(verdicts: DataFrame, host: str = "host", fault: str = "fault") -> DataFrame:
    """host, n, faults, the shrunk share ``rate`` of each host, its posterior's standard deviation ``sd`` and the prior's ``mean``. Null is a host
    like others.

    With mean m and variance v of the hosts' shares the prior is Beta(m k, (1 - m) k), k = m (1 - m) / v - 1. If all shares
    are equal, or v is too large for a Beta, the prior has the weight of one document (k = 1).
    """
    hosts = verdicts.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(fault).cast("bigint")).alias("faults")
    )
    share = F.col("faults") / F.col("n")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v")).select(
        "m", F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > 2 * F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)
        .otherwise(F.lit(1.0)).alias("k")
    )
    rated = hosts.join(F.broadcast(prior)).select(  # the prior is one row
        "host", "n", "faults", ((F.col("faults") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate"), "m", "k"
    )
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("k") + 1))
    return rated.select("host", "n", "faults", "rate", sd.alias("sd"), F.col("m").alias("mean"))


def _bad_hosts(judged: DataFrame, rules: QualityRules) -> DataFrame:
    """Hosts that are surely worse than the prior allows. The table is written and counted, so that the texts are joined to it without a shuffle by host."""
    bad = host_rates(judged).filter(F.col("rate") - rules.host_sure * F.col("sd") > rules.host_factor * F.col("mean")).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    bad = materialise(bad, "quality-hosts")
    return small(bad, bad.count())


def quality_verdicts(
    documents: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """Per row of ``documents``: doc_id, the measures, base_failed and kept; other columns are ignored.

    A null, empty or blank text has no words and fails. A null host is a host of its own. Repeated rows are judged, and counted
    for their host, one by one. An empty table gives no rows. A document is rejected if it fails, or if its host is bad
    and it has any fault.
    """
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured, names = measure(narrow, rules)
    judged = measured.select("doc_id", "host", *[F.col(names[m]).alias(m) for m in MEASURES]).withColumns(
        {"base_failed": rules.failed(), "fault": rules.faulty()}
    )
    judged = materialise(judged, "quality-measures")  # without texts; the hosts' shares and the rows read it
    bad = _bad_hosts(judged, rules)
    out = judged.join(bad, judged.host.eqNullSafe(bad.bad_host), "left")
    kept = ~F.col("base_failed") & ~(F.col("bad").isNotNull() & F.col("fault"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_good(documents: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``documents`` that ``quality_verdicts`` keeps, with all their columns, whatever their names. Null, empty and blank texts go;
    repeated rows stay or go together; a null host is a host of its own; an empty table stays empty.

    The texts are measured twice, for the hosts' shares and for the rows themselves, rather than written or shuffled in between.
    """
    narrow, names = measure(documents.select(F.col(host).alias("host"), F.col(text).alias("text")), rules)
    judged = narrow.select("host", *[F.col(names[m]).alias(m) for m in MEASURES]).select("host", rules.faulty().alias("fault"))
    bad = _bad_hosts(judged, rules)
    measured, names = measure(documents, rules, text)
    rows = measured.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *[F.col(names[m]).alias(m) for m in MEASURES])
    rows = rows.select("row", F.col("row")[host].alias("host"), rules.failed().alias("failed"), rules.faulty().alias("fault"))
    kept = rows.filter("not failed").join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").filter(F.col("bad").isNull() | ~F.col("fault"))
    return kept.select("row.*")


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS run FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
c AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, run) AS n FROM w) WHERE n > 1),
r AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM c, range(8) x(k) GROUP BY row),
m AS (
  SELECT row, doc_id, source, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (row)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS fault
  FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (fault) AS faults FROM f GROUP BY source),
p AS (SELECT avg(faults / n) AS m, var_pop(faults / n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > 2 * v THEN m * (1 - m) / v - 1 ELSE 1 END AS k FROM p),
u AS (SELECT source, n, m, k, (faults + m * k) / (n + k) AS rate FROM h, k),
g AS (SELECT source, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > 1.2 * m AS bad FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND fault) AS kept
FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source
"""
