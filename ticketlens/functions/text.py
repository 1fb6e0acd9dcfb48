"""Text cleaning, validity, patterns and small scalar rules as Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.wordlists import COMPLAINT_KEYWORDS

# --- Fixed values ---------------------------------------------------------------------
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MONEY_PATTERN = r"(?i)\$[\d,]+(?:\.\d{1,2})?|[\d,]+\s*(?:dollars?|usd)"
PREVIEW_CHARS = 120

# ISO calendar dates.
DATE_PATTERN = r"\b\d{4}-\d{2}-\d{2}\b"
# A run that starts and ends with a letter or digit: a blank-separated word without outer punctuation.
WORD_PATTERN = r"[\p{L}\p{N}][^ ]*[\p{L}\p{N}]"
# Words of two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Characters that NFKC may change or join with their neighbours. ASCII, the accented letters of Latin-1, dashes
# and curly quotes are not among them.
_NFKC_OPEN = r"[\x{80}-\x{BF}\x{100}-\x{2011}\x{2017}\x{2020}-\x{10FFFF}]"
_SPACE = r"[\s\x1c-\x1f]"


@F.arrow_udf(T.StringType())
def _nfkc_python(texts: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves some letters and marks apart that NFKC joins.
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Rows that cannot change hand a null to the Python worker, not their text."""
    open_text = (F.octet_length(text) != F.length(text)) & text.rlike(_NFKC_OPEN)
    return F.coalesce(_nfkc_python(F.when(open_text, text)), text)


def fill_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean(text: Column, normalise: bool = True) -> Column:
    """NFKC, control characters out, white space collapsed. ``normalise=False`` stays in the JVM."""
    text = fill_text(text)
    return collapse_ws(strip_control(nfkc(text) if normalise else text))


def is_analyzable(cleaned: Column) -> Column:
    return F.length(F.trim(cleaned)) > 0


def has_text(text: Column) -> Column:
    """True when anything is left after the strip; stops at the first such character."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def long_enough(text: Column, n: int) -> Column:
    """True for texts of at least n characters after the strip; null counts as too short."""
    return F.coalesce(F.length(strip(text)) >= n, F.lit(False))


def min_length(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """Stripped texts of at least n characters; the rest of the rows is dropped."""
    return df.withColumn(text_col, strip(F.col(text_col))).filter(F.length(text_col) >= n)


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.filter(has_text(F.col(text_col))).withColumn(text_col, strip(F.col(text_col)))


def complaint_context(text: Column, extra_keywords: Iterable[str] = ()) -> Column:
    """True when any complaint keyword occurs anywhere in the text, also inside words."""
    words = [k for k in (*COMPLAINT_KEYWORDS, *extra_keywords)]
    return F.lower(fill_text(text)).rlike("|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in words))


def parse_money(amount: Column) -> Column:
    """Digits and dots as a number; null where they do not form one."""
    return F.regexp_replace(amount, r"[^0-9.]", "").try_cast("double")


def money_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MONEY_PATTERN), F.lit(0))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_CHARS)


def parse_ts(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Timestamps from text or timestamps; rows that do not parse are dropped."""
    parsed = F.col(col)
    if dict(df.dtypes)[col] == "string":
        parsed = F.try_to_timestamp(parsed)
    return df.withColumn(col, parsed.cast("timestamp_ntz")).filter(F.col(col).isNotNull())


def round_mean(value: Column, digits: int = 4) -> Column:
    """Round half away from zero. Means of floats differ in their last bits with the order of adding; a nudge
    far below the digits kept makes halves come out the same in whatever order."""
    return F.round(value + F.signum(value) * 10.0 ** -(digits + 5), digits)


def pct(part: Column, whole: Column) -> Column:
    """Share as text with one decimal; ``0.0%`` when there is nothing to divide by."""
    share = F.round(part / F.nullif(whole, F.lit(0)) * 100, 1)
    return F.when(whole == 0, F.lit("0.0%")).otherwise(F.format_string("%.1f%%", share))


def keyword_in(value: Column, words: Iterable[str]) -> Column:
    """Case-folded membership."""
    return F.lower(value).isin([w.lower() for w in words])


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first of the candidate names that the table has."""
    return next((c for c in candidates if c in df.columns), None)
