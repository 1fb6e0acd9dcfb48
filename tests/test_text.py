import unicodedata

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import arrays as ax
from ticketlens.functions import text as tx
from ticketlens.operators import tables as tb


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


SAMPLES = [
    "plain", "ﬁne ½ ﬀ", "Ｆｕｌｌ width", "café", "café", "x y", "…", "Å Å", "’quoted’ – dash — end", "naïve ÿ × ÷",
    "‑ ‗ €", "한국어 한", "𝔘nicode", "", None,
]


def test_nfkc_equals_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    got = {r["i"]: r["y"] for r in df.select("i", tx.nfkc(F.col("t")).alias("y")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(SAMPLES)}


def test_nfkc_sends_every_character_that_can_change(spark):
    # Every character left out of the Python pass must be stable alone and between its neighbours.
    kept = [chr(c) for c in range(0x80, 0x3000) if not (0x80 <= c <= 0xBF or 0x100 <= c <= 0x2011 or c == 0x2017 or c >= 0x2020)]
    assert all(unicodedata.normalize("NFKC", c) == c for c in kept)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in ["a", "e", *kept] for b in kept)


@pytest.mark.parametrize("raw, expected", [
    (None, ""), ("", ""), ("  \t\n", ""), (" a  b\n\nc ", "a b c"), ("\x00a\x07b\x7f", "ab"), ("x  y", "x y"), ("Ａ１", "A1"),
    ("tab\there", "tab here"), ("a\x1cb", "ab"),
])
def test_clean(spark, raw, expected):
    assert one(spark, raw, tx.clean) == expected


def test_strip_and_length(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), (" ab\x1f\n",), (" a ",), ("abc",)], "text string")
    assert [r["text"] for r in tx.min_length(rows, 2).collect()] == ["ab", "abc"]
    assert [r["text"] for r in tx.drop_blank(rows).collect()] == ["ab", "a", "abc"]


@pytest.mark.parametrize("raw, expected", [
    ("$100.00", 100.0), ("$1,234.50", 1234.5), ("30 dollars", 30.0), ("1.2.3", None), ("$", None), ("5 USD", 5.0), ("", None),
])
def test_parse_money(spark, raw, expected):
    assert one(spark, raw, tx.parse_money) == expected


def test_money_pattern(spark):
    text = "Paid $1,234.50 then 30 dollars, 5USD and 7 Dollar but not 12."
    assert one(spark, text, tx.money_matches) == ["$1,234.50", "30 dollars", "5USD", "7 Dollar"]


def test_complaint_is_substring_and_takes_extra_words(spark):
    assert one(spark, "Terrors of the night", tx.complaint_context) is True
    assert one(spark, "all fine", tx.complaint_context) is False
    assert one(spark, "all fine", lambda c: tx.complaint_context(c, ["fine"])) is True
    assert one(spark, None, tx.complaint_context) is False


def test_pct(spark):
    df = spark.createDataFrame([(1, 3), (5, 0), (1, 1)], "a int, b int")
    assert [r[0] for r in df.select(tx.pct(F.col("a"), F.col("b"))).collect()] == ["33.3%", "0.0%", "100.0%"]


def test_parse_ts_drops_what_does_not_parse(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02",), ("nope",), (None,)], "created_at string")
    assert tx.parse_ts(df).count() == 2


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 1000])
def test_running_total(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    expected = [sum(values[:i]) for i in range(n)]
    assert one(spark, values, ax.running_total, "array<bigint>") == expected


def test_map_and_require_columns(spark):
    df = spark.createDataFrame([("1", "hello", "x")], "id string, body string, extra string")
    out = tb.map_columns(df, ticket_id="id", text="body", created_at="when", priority=None)
    assert out.columns == ["ticket_id", "text", "extra"]
    with pytest.raises(ValueError, match="missing columns"):
        tb.require_columns(df, ["text"])
    with pytest.raises(ValueError):
        tb.map_columns(df)


def test_validate_counts(spark):
    df = spark.createDataFrame([("1", " a "), ("1", "a"), ("2", None), ("3", " "), ("4", "b")], "id string, text string")
    assert sorted(tuple(r) for r in tb.validate_tickets(df).collect()) == [("1", "a"), ("4", "b")]
    row = tb.validation_counts(df).first()
    assert (row["initial_rows"], row["kept_rows"], row["dropped_rows"]) == (5, 2, 3)
