"""Dates and amounts of money by grammar: a finite-state transducer over token classes.

A text becomes tokens (words, numbers, signs); each token has the classes that its spelling allows. The automaton reads classes from every
place where a phrase can begin and takes the longest accepted path; phrases do not overlap, the leftmost comes first. The
path's output gives the normalised value: an ISO date (or ``2024-03`` for a month), or an amount with its currency. Relative
dates count from the day the ticket was made.

Dates: ``2024-03-05``, ``March 5, 2024``, ``5th of March 2024``, ``Mar 5``, ``March 2024``, ``03/05/2024``, ``05.03.2024``, today, yesterday, tomorrow,
``last Friday``, ``next week``, ``3 days ago``, ``in two weeks``. Amounts: ``$1,234.50``, ``€50``, ``50 €``, ``40 euros``, ``USD 300``, ``$1.2 million``, ``5k dollars``,
``twenty-five pounds``, ``99 cents``.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.operators.entities import MIN_TEXT_LENGTH

TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")
_MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])} | {"sept": 9}
_DAYS = {name.lower(): i for i in range(7) for name in (calendar.day_name[i], calendar.day_abbr[i])} | {"tues": 1, "thur": 3, "thurs": 3}
_SMALL = {w: i for i, w in enumerate(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1000, "k": 1000, "million": 10**6, "mn": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9}
_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
_CODES = {c.lower(): c for c in ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD")}
_NAMES = {"dollar": "USD", "dollars": "USD", "bucks": "USD", "euro": "EUR", "euros": "EUR", "pound": "GBP", "pounds": "GBP", "quid": "GBP", "yen": "JPY",
          "franc": "CHF", "francs": "CHF"}
_CENTS = {"cent": "USD", "cents": "USD", "pence": "GBP"}
_UNITS = {u + s: u for u in ("day", "week", "month", "year") for s in ("", "s")}
_NEAR = {"today": 0, "yesterday": -1, "tomorrow": 1}
# Words and signs that rules name as they are written.
_WRITTEN = frozenset({"-", "/", ".", ",", "of", "the", "last", "next", "this", "ago", "in", "a", "and"})


class Token(NamedTuple):
    text: str
    start: int
    end: int
    spaced: bool  # white space stands before it
    classes: frozenset[str]


def tokens(text: str) -> list[Token]:
    out, before = [], 0
    for m in TOKEN.finditer(text):
        out.append(Token(m[0].lower(), m.start(), m.end(), m.start() > before or not out, _classes(m[0])))
        before = m.end()
    return out


@lru_cache(maxsize=1 << 16)
def _classes(word: str) -> frozenset[str]:
    low = word.lower()
    if word.isdigit() and word.isascii():
        n = len(word)
        kinds = {"num"} | ({"n12"} if n <= 2 and 1 <= int(word) <= 12 else set()) | ({"n31"} if n <= 2 and 1 <= int(word) <= 31 else set())
        return frozenset(kinds | ({"year"} if n == 4 and 1900 <= int(word) <= 2199 else set()) | ({"n3"} if n == 3 else set()) | ({"n2"} if n <= 2 else set()))
    kinds = set()
    for name, table in (
        ("month", _MONTHS), ("weekday", _DAYS), ("small", _SMALL), ("tens", _TENS), ("scale", _SCALES), ("sign", _SIGNS), ("code", _CODES),
        ("currency", _NAMES), ("cents", _CENTS), ("unit", _UNITS), ("near", _NEAR),
    ):
        if low in table:
            kinds.add(name)
    if low in ("st", "nd", "rd", "th"):
        kinds.add("ordinal")
    if low in ("may", "mar", "sun", "sat", "dec", "jan", "mon", "wed", "fri", "m", "k") and word[0].islower() and len(word) > 1:
        kinds -= {"month", "weekday"}  # words of their own unless capitalised
    if low in _WRITTEN:  # other words are not classes: "month" is no month and "code" no code
        kinds.add(low)
    return frozenset(kinds)


# Each rule: its name and a path of steps. A step is a class, with ``?`` if it may be left out, ``*`` if it may repeat; a leading ``~`` asks
# that no white space stands before the token. A rule's letters in ``=x`` name the step's token for the output.
RULES: tuple[tuple[str, str, str], ...] = (
    ("DATE", "iso", "year=y ~- ~n12=m ~- ~n31=d"),
    ("DATE", "ymd", "year=y ~/ ~n12=m ~/ ~n31=d"),
    ("DATE", "ymd", "n12=m ~/ ~n31=d ~/ ~year=y"),
    ("DATE", "ymd", "n31=d ~. ~n12=m ~. ~year=y"),
    ("DATE", "ymd", "month=m .? n31=d ~ordinal? ,? year=y"),
    ("DATE", "ymd", "n31=d ~ordinal? of? month=m .? ,? year=y"),
    ("DATE", "md", "month=m .? n31=d ~ordinal?"),
    ("DATE", "md", "the? n31=d ~ordinal? of? month=m"),
    ("DATE", "ym", "month=m .? of? ,? year=y"),
    ("DATE", "near", "near=r"),
    ("DATE", "weekday", "last=l weekday=w"),
    ("DATE", "weekday", "next=l weekday=w"),
    ("DATE", "weekday", "this=l weekday=w"),
    ("DATE", "shift", "last=l unit=u"),
    ("DATE", "shift", "next=l unit=u"),
    ("DATE", "ago", "num=n unit=u ago"),
    ("DATE", "ago", "small=n unit=u ago"),
    ("DATE", "ago", "a=n unit=u ago"),
    ("DATE", "ahead", "in num=n unit=u"),
    ("DATE", "ahead", "in small=n unit=u"),
    ("DATE", "ahead", "in a=n unit=u"),
    ("MONEY", "amount", "sign=c num=a ~,n3* ~.num? ~scale?"),
    ("MONEY", "amount", "sign=c num=a ~,n3* ~.num? scale?"),
    ("MONEY", "amount", "num=a ~,n3* ~.num? ~sign=c"),
    ("MONEY", "amount", "num=a ~,n3* ~.num? scale? sign=c"),
    ("MONEY", "amount", "num=a ~,n3* ~.num? ~scale? currency=c"),
    ("MONEY", "amount", "num=a ~,n3* ~.num? scale? currency=c"),
    ("MONEY", "amount", "num=a ~,n3* ~.num? scale? code=c"),
    ("MONEY", "amount", "code=c num=a ~,n3* ~.num? scale?"),
    ("MONEY", "words", "word* currency=c"),
    ("MONEY", "cents", "num=a cents=c"),
    ("MONEY", "cents", "small=a cents=c"),
)


@dataclass(frozen=True)
class Step:
    """One transition: token classes to read in a row, an optional name for the output, and whether it may be left out or repeat."""

    reads: tuple[tuple[str, bool], ...]
    name: str
    optional: bool
    repeats: bool


def _step(text: str) -> Step:
    body, _, name = text.partition("=")
    optional, repeats = body.endswith("?"), body.endswith("*")
    body = body.rstrip("?*")
    glued = body.startswith("~")
    body = body.removeprefix("~")
    if len(body) > 1 and body[0] in ",.":  # a sign with what stands right behind it
        return Step(((body[0], glued), (body[1:], True)), name, optional, repeats)
    return Step(((body, glued),), name, optional, repeats)


PATHS = [(label, output, tuple(_step(s) for s in path.split())) for label, output, path in RULES]
# A spelled number has no more words, as its scales fall; an amount has no more groups of three digits.
_MOST = {"word": 40, "n3": 6}
_WORD_CLASSES = ("small", "tens", "scale", "a", "and", "-")


def _any_of(words: Iterable[str]) -> str:
    """An expression for any of the words, letter by letter, so that a place is not tried once for every word."""
    rest: dict[str, list[str]] = {}
    for word in words:
        rest.setdefault(word[:1], []).append(word[1:])
    ways = [re.escape(first) + _any_of(ends) for first, ends in sorted(rest.items()) if first]
    return "(?:" + "|".join(ways) + ")" + ("?" if "" in rest else "") if ways else ""


# What can begin a phrase; texts without one of these are not tokenised at all.
MAYBE = r"[0-9$€£¥]"
MAYBE_WORDS = r"(?i)\b" + _any_of({*_NEAR, *_NAMES, *_CENTS, *_CODES, *_MONTHS, "last", "next", "this", "ago", "in"}) + r"\b"


def _first_kinds(path: tuple[Step, ...]) -> frozenset[str]:
    """Classes of the tokens with which a path can begin."""
    kinds: set[str] = set()
    for step in path:
        kind = step.reads[0][0]
        kinds |= set(_WORD_CLASSES) if kind == "word" else {kind}
        if not (step.optional or step.repeats):
            break
    return frozenset(kinds)


_FIRST = [_first_kinds(path) for *_, path in PATHS]
_NEEDED = [frozenset(kind for step in path if not (step.optional or step.repeats) for kind, _ in step.reads) for *_, path in PATHS]
_BEGIN = (
    {step.reads[0][0] for *_, path in PATHS for step in path[:1]} | {p[1].reads[0][0] for *_, p in PATHS if p[0].optional}
) - {"word"} | {"small", "tens", "a"}


@lru_cache(maxsize=1 << 12)
def _paths_from(classes: frozenset[str]) -> list[tuple[frozenset[str], str, str, tuple[Step, ...]]]:
    """The paths that can begin with a token of these classes, in their order, each behind the classes that it cannot do without."""
    if not classes & _BEGIN:
        return []
    return [(needed, *path) for needed, path, kinds in zip(_NEEDED, PATHS, _FIRST) if classes & kinds]


def _reads(step: Step, row: list[Token], at: int, first: bool) -> int:
    """How many tokens a step takes at a place; 0 if it cannot."""
    for k, (kind, glued) in enumerate(step.reads):
        if at + k >= len(row):
            return 0
        token = row[at + k]
        if glued and token.spaced and not first:
            return 0
        if kind == "word":
            if not token.classes & set(_WORD_CLASSES):
                return 0
        elif kind not in token.classes:
            return 0
    return len(step.reads)


def accept(row: list[Token], at: int, path: tuple[Step, ...]) -> tuple[int, dict[str, list[str]]] | None:
    """The end of the longest way of a path from a place, and the tokens of its named steps; all states are kept side by side."""
    best = None
    states = [(at, 0, {})]
    while states:
        after = []
        for place, state, held in states:
            if state == len(path):
                if best is None or place > best[0]:
                    best = (place, held)
                continue
            step = path[state]
            n = _reads(step, row, place, place == at)
            if n:
                name = step.name or step.reads[-1][0]
                if len(held.get(name, ())) >= _MOST.get(name, 1 << 30):
                    continue
                grown = {**held, name: [*held.get(name, []), row[place + n - 1].text]}
                after.append((place + n, state if step.repeats else state + 1, grown))
            if step.optional or step.repeats:
                after.append((place, state + 1, held))
        states = after
    return best


def _month_shift(day: dt.date, months: int) -> dt.date:
    total = day.year * 12 + day.month - 1 + months
    year, month = divmod(total, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def _moved(day: dt.date, unit: str, n: int) -> str | None:
    try:
        if unit in ("day", "week"):
            return (day + dt.timedelta(days=n * (7 if unit == "week" else 1))).isoformat()
        return _month_shift(day, n * (12 if unit == "year" else 1)).isoformat()
    except (OverflowError, ValueError):
        return None


def _date(year: int, month: int, day: int) -> str | None:
    try:
        return dt.date(year, month, day).isoformat()
    except ValueError:
        return None


def _count(word: str) -> int:
    return 1 if word == "a" else _SMALL[word] if word in _SMALL else int(word)


def _below_thousand(words: list[str], at: int) -> tuple[int, int]:
    """The number below 1,000 that begins at a place, and the place behind it; the same place if there is none."""
    def below_hundred(i: int) -> tuple[int, int]:
        if i < len(words) and words[i] in _SMALL:
            return _SMALL[words[i]], i + 1
        if i < len(words) and words[i] in _TENS:
            n = _TENS[words[i]]
            more = _SMALL.get(words[i + 1], 0) if i + 1 < len(words) else 0
            return (n + more, i + 2) if 1 <= more <= 9 else (n, i + 1)
        return 0, i

    n, to = below_hundred(at)
    if to == at and at + 1 < len(words) and words[at] == "a" and words[at + 1] in _SCALES:
        n, to = 1, at + 1
    if to > at and n and to < len(words) and words[to] == "hundred":
        more, end = below_hundred(to + 1)
        return 100 * n + more, end
    return n, to


def spelled(words: list[str]) -> int | None:
    """The number that words such as ``two thousand five hundred and six`` spell; None if they spell none. Scales must fall."""
    words = [w for w in words if w not in ("and", "-")]
    if words == ["a"]:
        return 1
    total, at, last = 0, 0, None
    while at < len(words):
        n, to = _below_thousand(words, at)
        if to == at:
            return None
        scale = _SCALES.get(words[to], 0) if to < len(words) else 0
        if scale < 1000:
            return total + n if to == len(words) else None
        if last is not None and scale >= last:
            return None
        total, at, last = total + n * scale, to + 1, scale
    return total if words else None


def value(output: str, held: dict[str, list[str]], today: dt.date | None) -> str | None:
    """The normalised value of an accepted path; None if it is no date or amount (as 31 February), or is relative without a day to count from."""
    def get(name: str) -> str:
        return held[name][0]

    if output in ("iso", "ymd"):
        month = _MONTHS.get(get("m")) or int(get("m"))
        return _date(int(get("y")), month, int(get("d")))
    if output == "ym":
        return f"{get('y')}-{_MONTHS[get('m')]:02d}"
    if output in ("amount", "cents", "words"):
        if output == "words":
            number = spelled(held.get("word", []))
            amount = None if number is None else Decimal(number)
        elif output == "cents":
            amount = Decimal(_count(get("a"))) / 100
        else:
            amount = Decimal("".join([get("a"), *held.get("n3", []), *(["." + get("num")] if "num" in held else [])]))
            for scale in held.get("scale", []):
                amount *= _SCALES[scale]
        if amount is None:
            return None
        code = get("c")
        return f"{amount:.2f} " + (_SIGNS.get(code) or _CODES.get(code) or _NAMES.get(code) or _CENTS[code])
    if today is None:
        return None
    if output == "near":
        return _moved(today, "day", _NEAR[get("r")])
    if output == "weekday":
        ahead = (_DAYS[get("w")] - today.weekday()) % 7
        ahead = ahead - 7 if get("l") == "last" else ahead if get("l") == "this" else ahead or 7
        return _moved(today, "day", ahead)
    if output == "shift":
        return _moved(today, _UNITS[get("u")], -1 if get("l") == "last" else 1)
    if output in ("ago", "ahead"):
        return _moved(today, _UNITS[get("u")], _count(get("n")) * (-1 if output == "ago" else 1))
    month, day = _MONTHS[get("m")], int(get("d"))  # the last such day, at most a week ahead
    for year in range(today.year + 1, today.year - 8, -1):
        found = _date(year, month, day)
        if found is not None and dt.date.fromisoformat(found) <= today + dt.timedelta(days=7):
            return found
    return None


def parse(text: str, today: dt.date | None = None) -> list[tuple[str, str, int, int, str]]:
    """(phrase, type, start, end, value) of a text's dates and amounts, leftmost and longest first, without overlap."""
    row, out, at = tokens(text), [], 0
    there = frozenset().union(*{t.classes for t in row})
    while at < len(row):
        best = None
        for needed, label, output, path in _paths_from(row[at].classes):
            if not needed <= there:
                continue
            found = accept(row, at, path)
            if found is not None and found[0] > at and (best is None or found[0] > best[0]):
                got = value(output, found[1], today)
                if got is not None:
                    best = (found[0], label, got)
        if best is None:
            at += 1
            continue
        start, end = row[at].start, row[best[0] - 1].end
        out.append((text[start:end], best[1], start, end, best[2]))
        at = best[0]
    return out


def grammar_entities(df: DataFrame, id_col: str = "ticket_id", text_col: str = "text", time_col: str | None = "created_at") -> DataFrame:
    """DATE and MONEY phrases with their values: (id, entity, entity_type, start, end, value), places in the stripped text.

    Phrases whose value cannot be told (no such day; relative without ``time_col`` or with a null time) are left out. Null, empty and
    one-character texts have none; repeated rows get equal answers; an empty table gives no rows. Whole texts are read.
    """
    kinds = [("entity", pa.string()), ("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = [], []
            for i, (text, day) in enumerate(zip(batch.column("text").to_pylist(), batch.column("day").to_pylist())):
                found = parse(text, day)
                source += [i] * len(found)
                rows += found
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(source, pa.int64())), *columns], ["id", *[k for k, _ in kinds]])

    day = F.col(time_col).try_cast("date") if time_col is not None and time_col in df.columns else F.lit(None).cast("date")
    # Through a generator, so that the filter reads the stripped text instead of stripping it again.
    texts = df.select(F.col(id_col).alias("id"), day.alias("day"), F.inline(F.array(F.struct(tx.strip(F.col(text_col)).alias("text")))))
    texts = texts.filter((F.length("text") >= MIN_TEXT_LENGTH) & (F.col("text").rlike(MAYBE) | F.col("text").rlike(MAYBE_WORDS)))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(run, f"id {kind}, entity string, entity_type string, start int, end int, value string")
    return out.withColumnRenamed("id", id_col)
