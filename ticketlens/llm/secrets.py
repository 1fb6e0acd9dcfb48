"""Secret scans with linked multipart credentials.

Three patterns find secrets by themselves. Other parts are too common to report alone: short access identifiers, account names, long
runs of key characters, endpoints. They are joined by intervals: two parts belong together if at most ``reach`` code points lie between
the end of the one and the start of the other, however long they are. A weak part is reported only
if a complementary one is there. An identifier and a key complement each other; an endpoint needs both. For the join every part is
filed under the bins of ``reach`` code points before its start and behind its end; parts of one kind do not overlap, so that a bin holds
a bounded number of them, and semi-joins never form pairs. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.arrays import running_total
from ticketlens.llm.frames import fresh, shuffled
from ticketlens.session import materialise


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "([A-Za-z0-9+/_.=-]+)"
_ACCOUNTS = "(" + "|".join(_either_case(w) for w in ("access_?key_?id", "client_?id", "user_?name", "account")) + ")"

# Reported by themselves, in this order. A match counts if its given group has the given length.
BASE = (("assign", _NAMES + _SIGN + _VALUE, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
# Reported if linked. ``key`` runs hold at least one digit in an ordinary credential, but none is asked for.
WEAK = (
    ("short_access", "A[A-Z]IA[A-Z0-9]+", 0, 12), ("account", _ACCOUNTS + _SIGN + _VALUE, 2, 4), ("key", "[A-Za-z0-9+/]+", 0, 32),
    ("endpoint", "[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.:-]+", 0, 11),
)
KINDS = [k for k, *_ in BASE + WEAK]
IDENTIFIERS = ("access", "short_access", "account")
KEYS = ("assign", "hex", "key")
REACH = 200
_BLOCK = 64
_SPAN = "struct<start:bigint,number:int,kind:string,end:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pattern(pattern: str, group: int, least: int) -> str:
    """A single run of characters of one class can be asked for its length at once; other patterns are matched as they are."""
    head, plus = pattern[:-1], pattern.endswith("]+")
    if group or not plus:
        return pattern
    fixed = len(pattern[: pattern.rindex("[", 0, pattern.rindex("]"))]) if pattern.startswith("AKIA") else 0
    return f"{head}{{{least - fixed},}}" if fixed or pattern.startswith("[0") or pattern.startswith("[A-Za-z0-9+/]") else pattern


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost matches, without overlap, in code points. A match starts where the pieces and matches before it end."""
    regex = _pattern(pattern, group, least)

    def placed(found: Column) -> Column:
        n = F.size(found)
        pieces = F.transform(F.slice(F.split(text, regex, -1), F.lit(1), n), lambda p: F.length(p).cast("bigint"))
        lengths = F.transform(found, lambda m: F.length(m).cast("bigint"))

        def ends(parts: Column) -> Column:
            before = _let(F.zip_with(parts, lengths, lambda p, m: p + m), running_total)
            rows = F.arrays_zip(
                before.alias("before"), parts.alias("piece"), lengths.alias("size"),
                F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(group)), F.length).alias("own"),
            )
            good = F.filter(rows, lambda r: r["own"] >= least)
            return F.transform(good, lambda r: F.struct(
                (r["before"] + r["piece"]).alias("start"), F.lit(KINDS.index(kind)).alias("number"), F.lit(kind).alias("kind"),
                (r["before"] + r["piece"] + r["size"]).alias("end"),
            ))

        return F.when(n > 0, _let(pieces, ends))

    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.coalesce(_let(found, placed), F.array().cast(f"array<{_SPAN}>"))


def _row_key(doc_id: str, text: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))


def scan(documents: DataFrame, reach: int = REACH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, row_key, base and spans, arrays of (start, number, kind, end) in code points, ends exclusive.

    ``base`` holds the matches of the patterns that stand for themselves, ``spans`` also the linked weak parts, both by
    start and then kind. A weak span that equals a base span is not given twice. Null is an empty text. Rows with equal id and text
    get equal answers. An empty table gives no rows. Other columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    strong = F.array_sort(F.concat(*[_spans(whole, *p) for p in BASE]))
    weak = F.concat(*[_spans(whole, *p) for p in WEAK])
    found = materialise(
        documents.select(F.col(doc_id).alias("doc_id"), _row_key(doc_id, text).alias("row_key"), strong.alias("base"), weak.alias("weak")), "secrets-found"
    )
    some = found.filter("size(weak) > 0").select("row_key", F.explode(F.concat("base", "weak")).alias("s")).select("row_key", "s.*").distinct()

    def beside(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows with one of the others at most ``reach`` code points behind their end or before their start."""
        def place(side: str, at: Column) -> Column:
            return F.struct(F.lit(side).alias("side"), F.floor(at / reach).alias("bin"))

        start, end = F.col("start"), F.col("end")
        fields = [place("before", start - reach), place("before", start), place("behind", end), place("behind", end + reach)]
        filed = others.select(
            F.col("row_key").alias("o_row"), start.alias("o_start"), end.alias("o_end"), F.explode(F.array(*fields)).alias("o_place")
        ).distinct()
        placed = rows.withColumn("place", F.explode(F.array(place("before", end), place("behind", start))))
        close = F.when(F.col("place.side") == "before", F.col("o_start") - end).otherwise(start - F.col("o_end")).between(0, reach)
        return placed.join(shuffled(filed), (F.col("row_key") == F.col("o_row")) & (F.col("place") == F.col("o_place")) & close, "left_semi").drop("place").distinct()

    identifiers, keys = some.filter(F.col("kind").isin(*IDENTIFIERS)), some.filter(F.col("kind").isin(*KEYS))
    is_weak = F.col("number") >= len(BASE)
    linked = (
        beside(identifiers.filter(is_weak), keys)
        .union(beside(keys.filter(is_weak), identifiers))
        .union(beside(beside(some.filter("kind = 'endpoint'"), identifiers), keys))
    )
    extra = linked.groupBy("row_key").agg(F.collect_list(F.struct("start", "number", "kind", "end")).alias("extra"))
    out = found.select("doc_id", "row_key", "base").join(shuffled(extra), "row_key", "left")
    added = F.filter(
        F.coalesce("extra", F.array().cast(f"array<{_SPAN}>")),
        lambda e: ~F.exists("base", lambda b: (b["start"] == e["start"]) & (b["end"] == e["end"])),
    )
    return out.select("doc_id", "row_key", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, and all spans as a string."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{k}") for k, *_ in BASE]
    return scanned.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, marker: str = "[SECRET]", reach: int = REACH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with every span of its texts replaced by ``marker``; spans that touch or overlap get one. A column ``n_chars``
    is set to the new length in code points. Rows without a span, null and empty texts among them, stay as they are; rows with equal id and text get
    equal texts; an empty table stays empty. Other columns are kept, whatever their names."""
    spans = scan(documents, reach, doc_id, text).filter("size(spans) > 0").select(F.col("row_key").alias("_key"), F.col("spans").alias("_spans"))
    spans = spans.dropDuplicates(["_key"])
    joined = documents.alias("d").join(shuffled(spans).alias("s"), _row_key(f"d.{doc_id}", f"d.{text}") == F.col("s._key"), "left")
    body = F.col(f"d.{text}")
    nothing = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        apart = (s["start"] > acc["upto"]) | (acc["upto"] < 0)
        upto = F.greatest(acc["upto"], F.lit(0).cast("bigint"))
        gap = F.array(body.substr((upto + 1).cast("int"), (s["start"] - upto).cast("int")), F.lit(marker))
        return F.struct(F.greatest(upto, s["end"]).alias("upto"), F.concat(acc["parts"], F.when(apart, gap).otherwise(nothing)).alias("parts"))

    def block(acc: Column, part: Column) -> Column:
        # A growing array is copied at each step, so the pieces are joined block by block.
        done = F.aggregate(part, F.struct(acc["upto"].alias("upto"), nothing.alias("parts")), step)
        return _let(done, lambda d: F.struct(d["upto"].alias("upto"), F.concat(acc["parts"], F.array(F.array_join(d["parts"], ""))).alias("parts")))

    found_spans = F.col("s._spans")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found_spans) - 1) / _BLOCK).cast("int")), lambda b: F.slice(found_spans, b * _BLOCK + 1, F.lit(_BLOCK)))
    start = F.struct(F.lit(-1).cast("bigint").alias("upto"), nothing.alias("parts"))
    cleaned = F.aggregate(
        blocks, start, block, lambda acc: F.concat(F.array_join(acc["parts"], ""), body.substr((acc["upto"] + 1).cast("int"), F.length(body))),
    )
    new = F.when(F.col("s._spans").isNull(), body).otherwise(cleaned)
    found, changed = fresh("_found", documents.columns), fresh("_changed", documents.columns)
    columns = [F.col(f"`{c}`") if c != text else F.col(changed).alias(text) for c in documents.columns]
    out = joined.select("d.*", F.col("s._spans").isNotNull().alias(found), new.alias(changed))
    if "n_chars" in documents.columns:
        at = documents.columns.index("n_chars")
        size = F.when(F.col(found), F.length(changed)).otherwise(F.col("n_chars"))
        columns[at] = size.cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*columns)


def oracle() -> str:
    def listed(kind: str, pattern: str, group: int, least: int) -> str:
        regex = pattern.replace("'", "''")
        pieces, found = f"regexp_split_to_array(t, '{regex}')", f"regexp_extract_all(t, '{regex}')"
        return f"""
    SELECT row, '{kind}' AS kind, {KINDS.index(kind)} AS number, start, start + length(found[i]) AS "end" FROM (
      SELECT row, i, found, own, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT row, {pieces} AS pieces, {found} AS found, regexp_extract_all(t, '{regex}', {group}) AS own FROM d WHERE regexp_matches(t, '{_pattern(pattern, group, least).replace("'", "''")}'))))
    WHERE length(own[i]) >= {least}"""

    strong = " UNION ALL ".join(listed(*p) for p in BASE)
    weak = " UNION ALL ".join(listed(*p) for p in WEAK)
    ids, keys = (", ".join(f"'{k}'" for k in ks) for ks in (IDENTIFIERS, KEYS))

    def near(kinds: str) -> str:
        return f"""EXISTS (SELECT 1 FROM p o WHERE o.row = w.row AND o.kind IN ({kinds}) AND
      (o.start - w."end" BETWEEN 0 AND {REACH} OR w.start - o."end" BETWEEN 0 AND {REACH}))"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({strong}),
w AS ({weak}),
p AS (SELECT * FROM b UNION ALL SELECT * FROM w),
x AS (
  SELECT * FROM w WHERE ((kind IN ({ids}) AND {near(keys)}) OR (kind IN ({keys}) AND {near(ids)}) OR (kind = 'endpoint' AND {near(keys)} AND {near(ids)}))
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = w.row AND b.start = w.start AND b."end" = w."end")),
r AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) AS base FROM b GROUP BY row),
a AS (SELECT row, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM x) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (row) LEFT JOIN a USING (row)
"""
