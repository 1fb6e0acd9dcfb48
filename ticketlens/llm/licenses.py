"""License scans by ordered signature rules.

A text is folded to lower-case words with one blank between. Words that no rule looks up are out at once; each rule is gated by the words
that all its matches hold, so that a text meets few patterns and most texts none. Matches are places of words. A match that lies
within a match of a stronger level, or of its own level that is longer or from an earlier rule, is suppressed: "general public license"
within "gnu lesser general public license version 3" is no licence of its own. The base phrases are always reported as well.

Everything is an expression over one row: no text moves, no join, no shuffle, no Python. Suppression sorts a text's matches and compares
each with the largest ends before it, in blocks, so that texts with very many matches stay near linear.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.arrays import running_total
from ticketlens.llm.license_rules import BASE, CONFIDENCE, Rule, license_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCK = 64
_RULE = "struct<number:int,level:int,label:string,words:array<string>,pattern:string,base:boolean>"
_MATCH = "array<struct<start:bigint,end:bigint,number:int,level:int,label:string,base:boolean>>"
_LEVELS = sorted(CONFIDENCE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often it is read."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def folded_words(text: Column) -> Column:
    """Words in lower case (A-Z only) with one blank before, between and behind; one blank if there is none."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _OTHER, " "))
    return F.when(plain == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _places(words: Column, rule: Column) -> Column:
    """All leftmost matches of a rule, without overlap, as places of words, ends exclusive."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda m: _blanks(m) + 1)
        gaps = F.transform(F.slice(F.split(words, pattern, -1), F.lit(1), F.size(found)), _blanks)
        # Between two matches the blank on either side belongs to the gap, so n blanks hold n - 1 words.
        return _let(F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), lambda rows: _let(
            F.transform(rows, lambda r: r["gap"] - 1 + r["n"]), lambda steps: F.zip_with(rows, running_total(steps), _match)))

    def _match(row: Column, before: Column) -> Column:
        start = before + row["gap"] - 1
        return F.struct(start.alias("start"), (start + row["n"]).alias("end"), *[rule[c].alias(c) for c in ("number", "level", "label", "base")])

    empty = F.array().cast(_MATCH)
    return _let(F.regexp_extract_all(words, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(empty))


def _within(d: Column, e: Column) -> Column:
    """Whether ``e``, which stands before ``d`` by start, end and level, suppresses it."""
    return (e["level"] <= d["level"]) & (e["end"] >= d["end"])


def unsuppressed(matches: Column) -> Column:
    """The matches that no other one suppresses, by start, then longest, level and rule."""
    def ordered(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["level"].alias("level"), m["number"].alias("number"), m.alias("match"))

    def kept(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int")), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))

        def ends(block: Column) -> Column:
            return F.struct(*[
                F.coalesce(F.array_max(F.transform(F.filter(block, lambda e, level=level: e["level"] <= level), lambda e: e["end"])), F.lit(-1).cast("bigint")).alias(f"l{level}")
                for level in _LEVELS
            ])

        def grown(sofar: Column, block: Column) -> Column:
            last = F.get(sofar, F.size(sofar) - 1)
            return F.concat(sofar, F.array(_let(ends(block), lambda e: F.struct(*[F.greatest(last[f"l{n}"], e[f"l{n}"]).alias(f"l{n}") for n in _LEVELS]))))

        none = F.array(F.struct(*[F.lit(-1).cast("bigint").alias(f"l{n}") for n in _LEVELS]))

        def left(block: Column, before: Column) -> Column:
            def free(d: Column, i: Column) -> Column:
                reach = F.element_at(F.array(*[before[f"l{n}"] for n in _LEVELS]), d["level"])
                return (reach < d["end"]) & ~F.exists(F.slice(block, F.lit(1), i), lambda e: _within(d, e))

            return F.filter(block, free)

        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(F.aggregate(bs, none, grown), F.lit(1), F.size(bs)), left)))

    rows = F.transform(F.array_sort(F.transform(matches, ordered)), lambda o: o["match"])
    return F.when(F.size(matches) > 1, _let(rows, kept)).otherwise(matches)


def scan_licenses(
    documents: DataFrame, rules: Sequence[Rule] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, found (all matches) and kept (those that are not suppressed), both arrays of
    (start, end, number, level, label, base) in words, ends exclusive.

    Words are the maximal runs of letters and digits of ASCII and of all other characters beyond ASCII, A-Z folded. A null, empty or
    wordless text has no words and no matches. Rows are independent: repeated rows get equal answers, ids may be of any type
    and null, other columns are ignored, an empty table gives no rows. Levels run from 1 to 4. Whole texts are searched.
    """
    rules = list(license_rules() if rules is None else rules)
    looked_up: dict[str, list[dict]] = {}
    for r in rules:
        looked_up.setdefault(r.words[0], []).append(
            {"number": r.number, "level": r.level, "label": r.label, "words": list(r.words[1:]), "pattern": r.pattern, "base": r.base}
        )
    gates = F.from_json(F.lit(json.dumps(sorted({w for r in rules for w in r.words}))), "array<string>")
    table = F.from_json(F.lit(json.dumps(looked_up)), f"map<string,array<{_RULE}>>")
    rows = _once(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_raw")), "_text", folded_words(F.col("_raw"))).drop("_raw")
    rows = _once(rows, "_gates", F.array_intersect(F.split("_text", " "), gates))
    asked = F.filter(
        F.flatten(F.transform("_gates", lambda g: F.coalesce(F.try_element_at(table, g), F.array().cast(f"array<{_RULE}>")))),
        lambda r: F.forall(r["words"], lambda w: F.array_contains(F.col("_gates"), w)),
    )
    matches = F.flatten(F.transform(asked, lambda r: _places(F.col("_text"), r)))
    rows = _once(rows, "found", F.when(F.size("_gates") > 0, matches).otherwise(F.array().cast(_MATCH)))
    rows = _once(rows, "kept", unsuppressed(F.col("found")))
    return rows.select("doc_id", (_blanks(F.col("_text")) - 1).alias("n_words"), "found", "kept")


def license_digests(scanned: DataFrame) -> DataFrame:
    """Places and labels of the base phrases, all labels, and a score: the confidence of the strongest match that was kept, 0 without one."""
    def labels(matches: Column) -> Column:
        return F.transform(matches, lambda m: m["label"])

    base = F.filter("found", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    level = F.array_min(F.transform("kept", lambda m: m["level"]))
    score = F.element_at(F.array(*[F.lit(CONFIDENCE[n]) for n in _LEVELS]), level)
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels(base))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels(base), labels(F.col("kept"))))), ",").alias("labels"),
        F.when(level.isNull(), F.lit(0.0)).otherwise(score).alias("score"),
    )


def oracle() -> str:
    """The same in SQL: words stand two blanks apart, so that a match can take one on either side."""
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rules = ",\n".join(
        f"({r.number}, {r.level}, {quoted(r.label)}, [{', '.join(map(quoted, r.words))}], {quoted(' (?:' + r.pattern.replace('[^ ]', '[^~]').replace(' ', '  ').replace('[^~]', '[^ ]') + ') ')}, {r.base})"
        for r in license_rules()
    )
    score = " ".join(f"WHEN {n} THEN {c}" for n, c in CONFIDENCE.items())
    return f"""
WITH r(number, level, label, gates, pattern, base) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
x AS (
  SELECT row, number, level, label, base, pattern, ' ' || array_to_string(words, '  ') || ' ' AS t
  FROM (SELECT row, words, unnest(list_distinct(words)) AS w FROM d) JOIN r ON gates[1] = w WHERE list_has_all(words, gates)),
y AS (SELECT *, regexp_extract_all(t, pattern) AS found, regexp_split_to_array(t, pattern) AS pieces FROM x WHERE regexp_matches(t, pattern)),
z AS (
  SELECT row, number, level, label, base, unnest(list_transform(range(1, len(found) + 1), lambda i: struct_pack(
    n := len(regexp_extract_all(found[i], '[^ ]+')), before := array_to_string(list_transform(range(1, i + 1), lambda k: pieces[k] || (CASE WHEN k < i THEN found[k] ELSE '' END)), '')))) AS m
  FROM y),
m AS (SELECT row, number, level, label, base, len(regexp_extract_all(m.before, '[^ ]+')) AS start, len(regexp_extract_all(m.before, '[^ ]+')) + m.n AS "end" FROM z),
k AS (
  SELECT row, level, label FROM m a WHERE NOT EXISTS (
    SELECT 1 FROM m b WHERE b.row = a.row AND b.start <= a.start AND b."end" >= a."end" AND b.level <= a.level
      AND (b.start < a.start OR b."end" > a."end" OR b.level < a.level OR b.number < a.number))),
b AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m WHERE base GROUP BY row),
l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM k UNION ALL SELECT row, label FROM m WHERE base) GROUP BY row),
s AS (SELECT row, CASE min(level) {score} END AS score FROM k GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN l USING (row) LEFT JOIN s USING (row)
"""
