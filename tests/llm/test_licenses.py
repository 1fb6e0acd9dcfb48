import random
import re
import time

import pytest

from ticketlens.llm.license_rules import BASE, CONFIDENCE, Rule, license_rules
from ticketlens.llm.licenses import license_digests, scan_licenses

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, found string, level int"
RULES = license_rules()


def brute(text, rules=RULES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    line = " " + "".join(w + " " for w in words)
    found = []
    for r in rules:
        if set(r.words) <= set(words):
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, r.number, r.level, r.label, r.base))
    kept = [d for d in found if not any(
        e[0] <= d[0] and d[1] <= e[1] and (e[3] < d[3] or e[3] == d[3] and (e[:2] != d[:2] or e[2] < d[2])) for e in found)]
    base = [d for d in found if d[5]]
    return (
        len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})),
        ",".join(sorted({d[4] for d in base + kept})), max((CONFIDENCE[d[3]] for d in kept), default=0.0),
    ), sorted(found), sorted(kept)


def scanned(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], SCHEMA)
    return scan_licenses(df, **options)


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("under the GNU Lesser General Public License v2.1 or (at your option) any later version", "gpl,lgpl-2.1-or-later"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("cc-by", "cc-by"), ("Released under the MIT License.", "mit"),
    ("Das Haus mit Garten, mit und ohne.", ""), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("All rights reserved.", "reserved"),
    ("GPLv3 only", "gpl-3.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"), ("(c) 2020 CC by all rights. Reserved", "cc-by,reserved"),
    ("Redistribution and use in source and binary forms, with or without modification", "bsd"), ("SPDX-License-Identifier: ISC", "isc"),
    ("éCC by CC byé cc BY", "cc-by"), ("MPL 2.0 and MIT No Attribution", "mit-0,mpl-2.0"),
])
def test_labels(text, labels):
    assert brute(text)[0][5] == labels


def test_rules():
    assert len(RULES) >= 300 and [r.number for r in RULES] == list(range(len(RULES)))
    assert [(r.label, r.pattern) for r in RULES if r.base] == [(label, phrase) for label, _, phrase in BASE]
    assert all(r.level in CONFIDENCE and r.words for r in RULES)


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = sorted({w for r in RULES for w in re.findall("[a-z0-9]+", r.pattern)})
    texts = [None, "", " -- ", "x", "CC BY", "cc\nby cc.by", "all rights reserved " * 3, "ß©2020 © 2020", "\x00cc\x7fby"]
    for r in RULES:  # one text that the rule matches, between others' words
        phrase = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)[?+]?|\{[^}]*\}\??", r"\1", r.pattern)
        texts.append(f"{rnd.choice(vocabulary)}, {phrase}. {' '.join(rnd.choices(vocabulary, k=9))} {phrase.upper()}")
    texts += [" ".join(rnd.choices(["cc", "by", "nc", "sa", "4", "0", "gnu", "general", "public", "license", "version", "3", "the", "under", "licensed", "mit", "all",
                                    "rights", "reserved", "copyright", "2020"], k=rnd.randint(1, 120))) for _ in range(150)]
    got = scanned(spark, texts)
    fields = ("start", "end", "number", "level", "label", "base")
    rows = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        digest, found, kept = brute(t)
        assert sorted(tuple(m[f] for f in fields) for m in rows[i].found) == found, t
        assert sorted(tuple(m[f] for f in fields) for m in rows[i].kept) == kept, t
        assert rows[i].n_words == digest[0]
    digests = {r.doc_id: tuple(r)[1:] for r in license_digests(got).collect()}
    assert digests == {i: brute(t)[0] for i, t in enumerate(texts)}


def test_many_matches_and_own_rules(spark):
    rules = [Rule(0, 2, "inner", ("b",), "b c"), Rule(1, 3, "outer", ("a",), "a b c d"), Rule(2, 2, "tie", ("c",), "b c"), Rule(3, 1, "strong", ("s",), "s b c")]
    text = " ".join(["a b c d x s b c"] * 300)
    got = scanned(spark, [text], rules=rules).collect()[0]
    _, found, kept = brute(text, rules)
    assert len(got.found) == len(found) == 1800 and sorted((m.start, m.label) for m in got.kept) == sorted((d[0], d[4]) for d in kept)
    start = time.time()
    long = scanned(spark, ["licensed under the mit license all rights reserved " * 20_000]).collect()[0]
    assert len(long.kept) == 40_000 and time.time() - start < 120


def test_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("d-1", "cc by"), (None, "cc by")], "key string, body string")
    got = license_digests(scan_licenses(df, doc_id="key", text="body")).collect()
    assert sorted((r.doc_id or "", r.labels) for r in got) == [("", "cc-by"), ("d-1", "cc-by")]
    assert scanned(spark, ["a"]).limit(0).collect() == [] and scan_licenses(df.limit(0), doc_id="key", text="body").collect() == []
