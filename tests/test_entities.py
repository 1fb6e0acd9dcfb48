from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import entities as en

TICKETS = [
    ("1", "  My Red Widget costs $100.00 and the red widget costs $100.01. "),
    ("2", "The blue bolt from Acme is broken, refund 30 dollars by 2024-01-05!"),
    ("3", None), ("4", "x"), ("5", "nothing here"),
    ("6", "red widget red widget, $1,234.50 in Paris on 2024-01-05 and $1,234.50 again"),
    ("7", "blue bolt of ACME"),
    ("8", "red  widget and red\nwidget; red, widget"),
]
NAMES = [("red widget", "PRODUCT"), ("blue bolt", "PRODUCT"), ("acme", "ORG"), ("paris", "GPE"), ("paris", "PERSON"), ("widget", "ORG")]


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.createDataFrame(TICKETS, "ticket_id string, text string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "name string, label string")


@pytest.fixture(scope="module")
def mentions(tickets, names):
    return en.entity_mentions(tickets, names).cache()


def test_offsets_point_at_the_mention(mentions):
    texts = {i: t.strip() for i, t in TICKETS if t}
    rows = mentions.collect()
    assert rows
    for r in rows:
        assert texts[r["ticket_id"]][r["start"] : r["end"]] == r["entity"]


def test_mentions_do_not_overlap_and_longest_wins(mentions):
    by_ticket = {}
    for r in mentions.collect():
        by_ticket.setdefault(r["ticket_id"], []).append(r)
    for rows in by_ticket.values():
        rows.sort(key=lambda r: r["start"])
        assert all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:]))
    assert [(r["entity"], r["entity_type"]) for r in by_ticket["1"]] == [
        ("Red Widget", "PRODUCT"), ("$100.00", "MONEY"), ("red widget", "PRODUCT"), ("$100.01", "MONEY"),
    ]
    assert [(r["entity"], r["entity_type"]) for r in by_ticket["8"]] == [
        ("red  widget", "PRODUCT"), ("red\nwidget", "PRODUCT"), ("widget", "ORG"),
    ]


def test_equal_matches_have_their_own_offsets(mentions):
    starts = [r["start"] for r in mentions.filter("ticket_id = '6' and entity = '$1,234.50'").collect()]
    assert len(starts) == len(set(starts)) == 2


def test_every_ticket_keeps_a_row(tickets, names):
    out = {r["ticket_id"]: r["entities"] for r in en.extract_entities(tickets, names).collect()}
    assert set(out) == {i for i, _ in TICKETS}
    assert out["3"] == out["4"] == out["5"] == []


def test_long_text_offsets(spark, names):
    text = " ".join(["word"] * 500 + ["red widget"] + ["w"] * 300 + ["acme"])
    rows = en.gazetteer_entities(spark.createDataFrame([("1", text)], "ticket_id string, text string"), names).collect()
    assert {text[r["start"] : r["end"]] for r in rows} == {"red widget", "widget", "acme"}


def test_target_types_and_own_extractor(tickets, names):
    only = en.entity_mentions(tickets, names, types=["GPE"])
    assert {r["entity"] for r in only.collect()} == {"Paris"}
    given = en.entity_mentions(tickets, extractor=lambda df: df.select(
        "ticket_id", F.lit("all").alias("entity"), F.lit("ORG").alias("entity_type"), F.lit(0).alias("start"), F.lit(3).alias("end")))
    assert given.count() == len(TICKETS)


def test_counts_against_plain_python(mentions):
    rows = mentions.collect()
    counts = Counter((r["entity"], r["entity_type"]) for r in rows)
    assert {(r["entity"], r["entity_type"]): r["count"] for r in en.entity_counts(mentions).collect()} == counts
    assert sum(r["count"] for r in en.type_distribution(mentions).collect()) == len(rows)
    sets = {}
    for r in rows:
        sets.setdefault(r["ticket_id"], set()).add(r["entity"])
    pairs = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    assert {(r["entity_a"], r["entity_b"]): r["count"] for r in en.co_occurrence(mentions).collect()} == pairs
    assert en.entity_pairs(mentions).count() == sum(pairs.values())


def test_totals_count_all_documents(tickets, mentions):
    row = en.entity_totals(mentions, tickets).first()
    assert row["n_documents_processed"] == len(TICKETS) and row["total_mentions"] == mentions.count()
    none = en.entity_totals(mentions.filter("false"), tickets).first()
    assert (none["total_unique_entities"], none["total_mentions"]) == (0, 0)


def test_critical_entities(tickets, mentions):
    out = {(r["entity"], r["entity_type"]): r for r in en.critical_entities(mentions, tickets).collect()}
    assert out[("$100.01", "MONEY")]["reason"] == "high_value_amount_100.01"
    assert out[("$1,234.50", "MONEY")]["reason"] == "high_value_amount_1234.50" and out[("$1,234.50", "MONEY")]["frequency"] == 2
    assert ("$100.00", "MONEY") not in out  # strictly above the limit
    # Neutral in ticket 7, in a complaint in ticket 2.
    assert out[("blue bolt", "PRODUCT")]["frequency"] == 2
    assert ("red widget", "PRODUCT") not in out
    wider = {r["entity"] for r in en.critical_entities(mentions, tickets, extra_keywords=["costs"]).collect()}
    assert "red widget" in wider


def test_report_parts(tickets, mentions):
    parts = en.entity_report(mentions, tickets, top_n=2)
    assert parts["top_entities"].count() == 2
    empty = en.entity_report(mentions.filter("false"), tickets)
    assert all(empty[k].count() == 0 for k in ("top_entities", "type_distribution", "critical_entities", "co_occurrence"))


def test_copies_of_one_ticket_give_their_pairs_once(spark):
    rows = [(str(i), e) for i in range(500) for e in ("a", "b", "c")]
    out = en.co_occurrence(spark.createDataFrame(rows, "ticket_id string, entity string")).collect()
    assert sorted((r["entity_a"], r["entity_b"], r["count"]) for r in out) == [("a", "b", 500), ("a", "c", 500), ("b", "c", 500)]


def test_names_as_users_write_them(spark):
    listed = ["acme co.", "red widget", "o'neill-smith", "new york city", "the very large blue bolt", "customer#0001", "c++", "at&t"]
    names = spark.createDataFrame([(n, "ORG") for n in listed], "name string, label string")
    text = (
        "Acme Co. sent 'red widget' and the red widget's lid, red widget- and (RED  WIDGET). O'Neill-Smith of New\tYork City likes "
        "the very large blue bolt; Customer#0001, C++ and AT&T. Not: redwidget, red widgets, customer#00012, new york, xc++, o'neill"
    )
    got = en.gazetteer_entities(spark.createDataFrame([("1", text), ("2", None), ("3", "acme co.")], "ticket_id string, text string"), names).collect()
    assert all(text[r["start"] : r["end"]] == r["entity"] for r in got if r["ticket_id"] == "1")
    assert sorted(r["entity"].lower() for r in got if r["ticket_id"] == "1") == sorted([
        "acme co.", "red widget", "red widget", "red widget", "red  widget", "o'neill-smith", "new\tyork city", "the very large blue bolt",
        "customer#0001", "c++", "at&t",
    ])
    assert [r["ticket_id"] for r in got if r["ticket_id"] != "1"] == ["3"]


def test_many_amounts_in_one_text(spark):
    text = " and ".join(f"${i}.50" for i in range(20_000))
    rows = en.pattern_entities(spark.createDataFrame([("1", text)], "ticket_id string, text string")).collect()
    assert len(rows) == 20_000 and all(text[r["start"] : r["end"]] == r["entity"] for r in rows)


def test_complaint_words_are_literal(spark):
    df = spark.createDataFrame([("it Broke a+b",), ("a REFUND",), ("fine",), (None,)], "text string")
    got = [r[0] for r in df.select(en.tx.complaint_context(F.col("text"), ["a+b", "x\\Ey"])).collect()]
    assert got == [True, True, False, False]


def test_empty_corpus_is_an_error(tickets, names):
    with pytest.raises(ValueError, match="no documents"):
        en.extract_entities(tickets.limit(0), names)


def test_patterns_and_names_are_computed_once_for_a_row(spark):
    """A column that is named several times inside functions on arrays is computed as often."""
    df = spark.createDataFrame([("a", "x $5 and $7 for the blue ring"), ("b", None)], "ticket_id string, text string")
    names = spark.createDataFrame([("blue ring", "PRODUCT")], "name string, label string")

    def plan(found):
        return found._jdf.queryExecution().optimizedPlan().toString()

    assert plan(en.pattern_entities(df)).count("regexp_extract_all") == 2
    found = en.gazetteer_entities(df, names)
    assert plan(found).count("regexp_extract_all") == 2  # tokens, and tokens with their blanks; those of the names are written
    assert [tuple(r) for r in found.collect()] == [("a", "blue ring", "PRODUCT", 20, 29)]


def test_places_of_names_far_into_a_text(spark):
    text = "　lead " + "blue  ring, x\U0001f600  Blue ring. " * 150 + "blue"
    names = spark.createDataFrame([("blue ring", "PRODUCT"), ("lead", "ORG")], "name string, label string")
    rows = en.gazetteer_entities(spark.createDataFrame([("a", text)], "ticket_id string, text string"), names).collect()
    stripped = text.strip()
    assert len(rows) == 301 and all(stripped[r.start : r.end] == r.entity for r in rows)
    assert len({r.start for r in rows}) == 301
