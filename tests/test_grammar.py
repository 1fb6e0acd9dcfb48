import datetime as dt
import random

import pytest

from ticketlens.operators import grammar as gr

DAY = dt.date(2024, 3, 13)  # a Wednesday

FORMS = {
    "March 3, 2024": "2024-03-03", "3rd of March 2024": "2024-03-03", "Mar 5": "2024-03-05", "the 5th of May": "2023-05-05", "03/04/2024": "2024-03-04",
    "25/04/2024": None, "04.03.2024": "2024-03-04", "2024-03-05": "2024-03-05", "2024-02-30": None, "29.02.2023": None, "last Friday": "2024-03-08", "next Monday": "2024-03-18",
    "this Wednesday": "2024-03-13", "next Wednesday": "2024-03-20", "yesterday": "2024-03-12", "3 days ago": "2024-03-10", "in two weeks": "2024-03-27",
    "a month ago": "2024-02-13", "March 2024": "2024-03", "last year": "2023-03-13", "€50": "50.00 EUR", "50 €": "50.00 EUR", "40 euros": "40.00 EUR",
    "$1.2 million": "1200000.00 USD", "USD 300": "300.00 USD", "300 USD": "300.00 USD", "1,234.50 dollars": "1234.50 USD", "$1,234,567.89": "1234567.89 USD",
    "five hundred dollars": "500.00 USD", "twenty-five pounds": "25.00 GBP", "a hundred and five euros": "105.00 EUR", "$5k": "5000.00 USD",
    "two thousand three hundred and forty-one yen": "2341.00 JPY", "99 cents": "0.99 USD", "ten pence": "0.10 GBP", "$": None, "12": None, "may": None, "1.2.3": None,
    "9999999 years ago": None, "a dollar": "1.00 USD",
}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    text = f"We met on {form}, then left."
    got = gr.parse(text, DAY)
    want = FORMS[form]
    assert [(text[a:b], e, v) for e, _, a, b, v in got] == ([(form, form, want)] if want else [])


def test_longest_and_leftmost():
    assert [r[0] for r in gr.parse("from March 3, 2024 to 5 April 2024, $20 or 30 euros and five six dollars", DAY)] == [
        "March 3, 2024", "5 April 2024", "$20", "30 euros", "six dollars"]
    assert [r[4] for r in gr.parse("On last Monday we lost $ 1,5 and 7,000 dollars", None)] == ["1.00 USD", "7000.00 USD"]


def every_way(row, at, path):
    """All ends that a path reaches, by trying each step each way."""
    if not path:
        return {at}
    step, ends = path[0], set()
    n = gr._reads(step, row, at, at == every_way.first)
    if n:
        ends |= every_way(row, at + n, path[1:])
        if step.repeats:
            ends |= every_way(row, at + n, path)
    if step.optional or step.repeats:
        ends |= every_way(row, at, path[1:])
    return ends


def test_automaton_equals_trying_all_ways():
    rnd = random.Random(8)
    units = ["$", "€", "1", "12", "234", ",", ".", " ", "2024", "March", "of", "/", "-", "million", "k", "dollars", "five", "hundred", "and", "twenty", "last", "week", "3", "days", "ago", "th", "in"]
    for _ in range(1500):
        row = gr.tokens("".join(rnd.choice(units) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 9))))
        for at in range(len(row)):
            for _, _, path in gr.PATHS:
                every_way.first = at
                ends = every_way(row, at, path) - {at}
                got = gr.accept(row, at, path)
                assert (max(ends) if ends else at) == (got[0] if got else at)


@pytest.mark.parametrize("n, word", [(0, "zero"), (7, "seven"), (21, "twenty one"), (100, "a hundred"), (999, "nine hundred and ninety nine"), (1_000_000, "one million"),
                                     (12_345, "twelve thousand three hundred forty five"), (None, "five six"), (None, "thousand"), (None, "one thousand two thousand"), (None, "a five")])
def test_spelled(n, word):
    assert gr.spelled(word.split()) == n


def test_rows(spark):
    rows = [(1, None, DAY), (2, "", DAY), (3, "x", DAY), (4, "  yesterday €5 ", DAY), (5, "yesterday €5", None), (5, "yesterday €5", None), (None, "2 euros", DAY),
            (6, "one " * 20_000 + "dollars " + "100," * 20_000 + "1 €", DAY)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "key int, body string, created_at date, value string, start int")
    got = sorted(((r.key, r.entity, r.entity_type, r.start, r.end, r.value) for r in gr.grammar_entities(df, "key", "body").collect()), key=repr)
    assert [g for g in got if g[0] != 6] == sorted([
        (4, "yesterday", "DATE", 0, 9, "2024-03-12"), (4, "€5", "MONEY", 10, 12, "5.00 EUR"), (5, "€5", "MONEY", 10, 12, "5.00 EUR"), (5, "€5", "MONEY", 10, 12, "5.00 EUR"),
        (None, "2 euros", "MONEY", 0, 7, "2.00 EUR")], key=repr)
    assert [g[5] for g in got if g[0] == 6] == ["1.00 EUR", "1.00 USD"]
    assert gr.grammar_entities(df.limit(0), "key", "body").collect() == []


@pytest.mark.parametrize("form", ["month 5", "code 300", "5 sign", "March year", "num euros", "unit ago"])
def test_names_of_classes_are_no_classes(form):
    assert [r for r in gr.parse(f"We met on {form}, then left.", DAY) if r[0] == form] == []


def test_paths_that_cannot_hold_are_not_tried(monkeypatch):
    tried = []
    accept = gr.accept
    monkeypatch.setattr(gr, "accept", lambda row, at, path: tried.append(at) or accept(row, at, path))
    assert gr.parse("The pallet waits 3 floors up, the number is 4711, of 12 in all. " * 20, DAY) == []
    assert not tried
