"""Entity mentions from patterns and a name table, and the aggregates over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import arrays as ax
from ticketlens.functions import text as tx
from ticketlens.functions.wordlists import ENTITY_TYPES
from ticketlens.session import materialise

# --- Fixed values ---------------------------------------------------------------------
MIN_TEXT_LENGTH = 2
HIGH_VALUE = 100.0
PRODUCT_REASON = "product_mentioned_in_complaint"
AMOUNT_REASON = "high_value_amount_%.2f"

MENTION = "array<struct<text:string,label:string,start:int,end:int>>"
_HEADS = ax.BitSet(2048)  # of names' first tokens
_BLOCK = 64  # mentions of a block in which overlaps are settled
# Tokens of names and texts alike: words, and every other sign by itself.
NAME_TOKEN = r"[a-zA-Z0-9_\p{L}\p{N}]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"
_PIECE = rf"(?:{NAME_TOKEN})[\s\p{{Z}}\x1c-\x1f\x85]*"  # a token with the blanks behind it


def pattern_mentions(text: Column, pattern: str, label: str) -> Column:
    """All matches of a pattern as an array of (text, label, start, end).

    Starts are the running length of what precedes: the pieces between matches and the matches themselves,
    so equal matches get their own offsets.
    """
    def placed(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda p: F.length(p).cast("bigint"))

        def mention(z: Column) -> Column:
            start = (z["before"] + z["gap"]).cast("int")
            return F.struct(z["m"].alias("text"), F.lit(label).alias("label"), start.alias("start"), (start + F.length(z["m"])).alias("end"))

        def mentions(gaps: Column) -> Column:
            before = ax.running_total(F.zip_with(gaps, matches, lambda g, m: g + F.length(m)))
            return F.transform(F.arrays_zip(before.alias("before"), gaps.alias("gap"), matches.alias("m")), mention)

        return F.when(F.size(matches) > 0, ax.let(gaps, mentions)).otherwise(F.from_json(F.lit("[]"), MENTION))

    return ax.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def pattern_entities(df: DataFrame, id_col: str = "ticket_id", text_col: str = "text") -> DataFrame:
    """MONEY and DATE mentions, one row each: (id, entity, entity_type, start, end)."""
    stripped = _readable(df, id_col, text_col)
    return stripped.filter(F.col("_text").rlike(r"\d")).select(id_col, F.inline(_pattern_arrays())).toDF(id_col, "entity", "entity_type", "start", "end")


def _pattern_arrays() -> Column:
    # Signs that every match holds are looked for first, which costs far less than a pattern.
    text, none = F.col("_text"), F.from_json(F.lit("[]"), MENTION)
    money = F.contains(text, F.lit("$")) | F.contains(F.lower(text), F.lit("dollar")) | F.contains(F.lower(text), F.lit("usd"))
    return F.concat(
        F.when(money, pattern_mentions(text, tx.MONEY_PATTERN, "MONEY")).otherwise(none),
        F.when(F.contains(text, F.lit("-")), pattern_mentions(text, tx.DATE_PATTERN, "DATE")).otherwise(none),
    )


def _readable(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # Through a generator, so that the filter reads the stripped text instead of stripping it again.
    stripped = df.select(id_col, F.inline(F.array(F.struct(tx.strip(F.col(text_col)).alias("_text")))))
    return stripped.filter(F.length("_text") >= MIN_TEXT_LENGTH)


def gazetteer(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """(name, label) from tables: each part is (table, name column, label). Names are compared in lower case, with single blanks."""
    out = None
    for table, column, label in parts:
        names = table.select(F.lower(tx.collapse_ws(F.col(column))).alias("name"), F.lit(label).alias("label"))
        out = names if out is None else out.unionByName(names)
    return out.filter(F.length("name") >= MIN_TEXT_LENGTH).distinct()


def _token_rows(df: DataFrame, longest: Column, heads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, head, start, pieces) of the tokens that may begin a name: in lower case, its place, and the tokens from it on with the blanks
    behind each, as many as the longest name has."""
    bits = _HEADS.of(heads.select(F.col("head").alias("value")))
    texts = _readable(df, id_col, text_col).withColumns({
        "_tokens": F.regexp_extract_all("_text", F.lit(NAME_TOKEN), F.lit(0)), "_pieces": F.regexp_extract_all("_text", F.lit(_PIECE), F.lit(0)),
    })
    # Prefix sums are for long texts only: in a short one it costs less to measure what lies before the few tokens that are kept.
    before = F.when(F.size("_pieces") > _BLOCK, ax.running_total(F.transform("_pieces", lambda p: F.length(p).cast("bigint"))))
    lead = F.length("_text") - F.length(F.array_join("_pieces", ""))
    # Tokens become rows and most are dropped at once, in compiled code; functions on arrays are interpreted. The outer form keeps the
    # optimizer from testing the array before it is taken apart, by building it twice.
    tokens = texts.select(id_col, "_tokens", "_pieces", lead.alias("_lead"), before.alias("_before")).select(
        id_col, "_pieces", "_lead", "_before", F.posexplode_outer("_tokens").alias("_at", "_token")
    )
    head = F.lower("_token")
    start = F.col("_lead") + F.coalesce(F.get("_before", F.col("_at")), F.length(F.array_join(F.slice("_pieces", F.lit(1), F.col("_at")), "")))
    return tokens.filter(_HEADS.may_hold(bits, head)).select(
        id_col, head.alias("head"), start.cast("int").alias("start"), F.slice("_pieces", F.col("_at") + 1, longest).alias("pieces")
    )


def gazetteer_entities(df: DataFrame, names: DataFrame, id_col: str = "ticket_id", text_col: str = "text") -> DataFrame:
    """Mentions of listed names of any number of words: (id, entity, entity_type, start, end).

    A name is found wherever the text has it, in any case, with any white space for a blank, between the borders of words.
    Tokens are first joined to the names' first tokens, which leaves the few places where a name can begin and the
    lengths it can have there; only these runs are joined to the names. Both are equi-joins with written tables, which Spark
    broadcasts if small. Only ids, short runs and their places are moved, never the text.
    """
    tokens = F.regexp_extract_all("name", F.lit(NAME_TOKEN), F.lit(0))
    split = names.select("name", "label", F.inline(F.array(F.struct(tokens.alias("_t")))))
    # Written, as the bit set, the longest name and both joins read them; the planner then knows their sizes as well.
    listed = materialise(split.select("name", "label", F.get("_t", F.lit(0)).alias("head"), F.size("_t").alias("n")).filter("n > 0"), "names")
    heads = materialise(listed.groupBy("head").agg(F.collect_set("n").alias("sizes")), "name-heads")
    longest = heads.agg(F.coalesce(F.max(F.array_max("sizes")), F.lit(1))).scalar()
    starts = _token_rows(df, longest, heads, id_col, text_col).join(heads, "head").select(id_col, "start", "pieces", F.explode("sizes").alias("n"))
    entity = tx.strip(F.array_join(F.slice("pieces", F.lit(1), F.col("n")), ""))
    runs = starts.filter(F.size("pieces") >= F.col("n")).select(id_col, "start", F.inline(F.array(F.struct(entity.alias("entity")))))
    runs = runs.withColumn("name", F.lower(tx.collapse_ws(F.col("entity"))))
    return runs.join(listed.select("name", "label"), "name").select(
        id_col, "entity", F.col("label").alias("entity_type"), "start", (F.col("start") + F.length("entity")).alias("end")
    )


def target_types(mentions: DataFrame, types: Iterable[str] = ENTITY_TYPES) -> DataFrame:
    return mentions.filter(F.col("entity_type").isin(list(types)))


def without_overlaps(mentions: Column) -> Column:
    """Left to right: a mention is kept when it starts at or after the end of the last one kept."""
    ordered = F.transform(
        F.array_sort(
            F.transform(mentions, lambda m: F.struct(m["start"].alias("s"), (-m["end"]).alias("e"), m["label"].alias("l"), m["text"].alias("t")))
        ),
        lambda m: F.struct(m["t"].alias("text"), m["l"].alias("label"), m["s"].alias("start"), (-m["e"]).alias("end")),
    )
    none = F.from_json(F.lit("[]"), MENTION)

    def step(acc: Column, m: Column) -> Column:
        free = m["start"] >= acc["end"]
        return F.struct(F.when(free, m["end"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["kept"], F.array(m))).otherwise(acc["kept"]).alias("kept"))

    def block(acc: Column, part: Column) -> Column:
        # A growing array is copied at each step, so kept mentions are gathered block by block.
        done = F.aggregate(part, F.struct(acc["end"].alias("end"), none.alias("kept")), step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["end"].alias("end"), F.concat(acc["kept"], F.array(d["kept"])).alias("kept"))), F.lit(0))

    def settle(rows: Column) -> Column:
        last = F.greatest(F.floor((F.size(rows) - 1) / _BLOCK).cast("int"), F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))
        start = F.struct(F.lit(-1).alias("end"), F.from_json(F.lit("[]"), f"array<{MENTION}>").alias("kept"))
        return F.aggregate(parts, start, block, lambda acc: F.flatten(acc["kept"]))

    return F.get(F.transform(F.array(ordered), settle), F.lit(0))


def _grouped(mentions: DataFrame, id_col: str) -> DataFrame:
    return mentions.groupBy(id_col).agg(
        without_overlaps(
            F.collect_list(F.struct(F.col("entity").alias("text"), F.col("entity_type").alias("label"), "start", "end"))
        ).alias("entities")
    )


def extract_entities(
    df: DataFrame,
    names: DataFrame | None = None,
    types: Iterable[str] = ENTITY_TYPES,
    extractor=None,
    id_col: str = "ticket_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, entities) for every ticket; null and short texts get an empty array. An empty table is an error.

    ``extractor`` replaces patterns and names by a function from the table to a mention table
    (id, entity, entity_type, start, end), for example a model behind ``mapInPandas``.
    """
    found = entity_mentions(require_texts(df), names, types, extractor, id_col, text_col, flat=False)
    empty = F.from_json(F.lit("[]"), MENTION)
    return df.select(id_col).join(found, id_col, "left").withColumn("entities", F.coalesce("entities", empty))


def entity_mentions(
    df: DataFrame,
    names: DataFrame | None = None,
    types: Iterable[str] = ENTITY_TYPES,
    extractor=None,
    id_col: str = "ticket_id",
    text_col: str = "text",
    flat: bool = True,
    tagger=None,
) -> DataFrame:
    """One row per mention: (id, entity, entity_type, start, end). One shuffle, on the ticket id.

    ``tagger``, a trained one, adds the names that no list holds. Its mentions meet the others under the same rule: leftmost, then longest.
    """
    if extractor is not None:
        found = extractor(df)
    else:
        found = pattern_entities(df, id_col, text_col)
        if names is not None:
            found = found.unionByName(gazetteer_entities(df, names, id_col, text_col))
        if tagger is not None:
            from ticketlens.operators.tagger import tagged_entities

            found = found.unionByName(tagged_entities(df, tagger, id_col, text_col)).distinct()
    grouped = _grouped(target_types(found, types), id_col)
    if not flat:
        return grouped
    return flat_mentions(grouped, id_col)


def flat_mentions(arrays: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """One row per mention from the arrays of ``extract_entities``."""
    return arrays.select(id_col, F.inline("entities")).toDF(id_col, "entity", "entity_type", "start", "end")


def require_texts(df: DataFrame) -> DataFrame:
    """The table itself; an empty corpus is an error."""
    if df.isEmpty():
        raise ValueError("no documents to extract entities from")
    return df


def entity_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity", "entity_type").agg(F.count("*").alias("count"))


def type_distribution(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_type").agg(F.count("*").alias("count"))


def entity_totals(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: distinct entities, mentions, and documents given (also those without a mention)."""
    totals = entity_counts(mentions).agg(
        F.count("*").alias("total_unique_entities"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_mentions")
    )
    return totals.withColumn("n_documents_processed", documents.agg(F.count("*")).scalar())


def entity_summary(mentions: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """Counts, most frequent first; with the reason beside them when critical entities are given."""
    out = entity_counts(mentions)
    if critical is not None:
        out = out.join(critical.select("entity", "entity_type", "reason"), ["entity", "entity_type"], "left")
    return out.orderBy(F.desc("count"), "entity", "entity_type")


def top_entities(mentions: DataFrame, n: int = 20) -> DataFrame:
    return entity_counts(mentions).orderBy(F.desc("count"), "entity", "entity_type").limit(n)


def entity_pairs(mentions: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Unordered pairs of distinct entity texts in one ticket: (id, entity_a, entity_b) with a < b."""
    sets = mentions.groupBy(id_col).agg(F.array_sort(F.collect_set("entity")).alias("set"))
    return _pairs(sets, id_col)


def _pairs(sets: DataFrame, *keep: str) -> DataFrame:
    """Pairs by position; a row carries its own two entities, not the set."""
    size = F.size("set")
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.slice("set", i + 1, size), lambda b: F.struct(F.element_at("set", i).alias("entity_a"), b.alias("entity_b")))
    ))
    return sets.filter(size > 1).select(*keep, F.inline(pairs))


def co_occurrence(mentions: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Tickets per pair of distinct entity texts.

    Tickets with the same entities are counted together before pairs are formed, so copies of one ticket
    give their pairs once, with a weight. ``mentions`` are rows or, without a second shuffle, the arrays of
    ``entity_mentions(flat=False)``.
    """
    if "entities" in mentions.columns:
        sets = mentions.select(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["text"]))).alias("set"))
    else:
        sets = mentions.groupBy(id_col).agg(F.array_sort(F.collect_set("entity")).alias("set"))
    distinct_sets = sets.filter(F.size("set") > 1).groupBy("set").agg(F.count("*").alias("weight"))
    return _pairs(distinct_sets, "weight").groupBy("entity_a", "entity_b").agg(F.sum("weight").alias("count"))


def critical_entities(
    mentions: DataFrame,
    df: DataFrame,
    extra_keywords: Iterable[str] = (),
    high_value: float = HIGH_VALUE,
    id_col: str = "ticket_id",
    text_col: str = "text",
) -> DataFrame:
    """(entity, entity_type, reason, frequency): products seen in a complaint, amounts above the limit.

    One pass over the mentions: the ids of complaint tickets are joined on the key by which mentions are
    already laid out, then counts and the complaint flag are taken together. A product counts as soon as one
    ticket makes it so.
    """
    complaints = df.filter(tx.complaint_context(F.col(text_col), extra_keywords)).select(id_col, F.lit(True).alias("_complaint"))
    concerned = mentions.filter(F.col("entity_type").isin("PRODUCT", "MONEY")).select(id_col, "entity", "entity_type")
    counted = concerned.join(complaints, id_col, "left").groupBy("entity", "entity_type").agg(
        F.count("*").alias("frequency"), F.max(F.coalesce("_complaint", F.lit(False))).alias("_complaint")
    )
    amount = tx.parse_money(F.col("entity"))
    reason = F.when((F.col("entity_type") == "PRODUCT") & F.col("_complaint"), F.lit(PRODUCT_REASON)).when(
        (F.col("entity_type") == "MONEY") & (amount > high_value), F.format_string(AMOUNT_REASON, F.round(amount, 2))
    )
    return counted.select("entity", "entity_type", reason.alias("reason"), "frequency").filter("reason is not null")


def critical_entities_sorted(critical: DataFrame) -> DataFrame:
    return critical.orderBy(F.desc("frequency"), "entity", "entity_type")


def entity_report(mentions: DataFrame, df: DataFrame, top_n: int = 20, **options) -> dict[str, DataFrame]:
    """All entity tables of a corpus. Pass a written mention table: each part reads it."""
    return {
        "top_entities": top_entities(mentions, top_n),
        "type_distribution": type_distribution(mentions),
        "totals": entity_totals(mentions, df),
        "critical_entities": critical_entities_sorted(critical_entities(mentions, df, **options)),
        "co_occurrence": co_occurrence(mentions),
        "entity_table": entity_summary(mentions),
    }
