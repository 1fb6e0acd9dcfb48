import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import entities as en
from ticketlens.operators import tagger as tg
from ticketlens.plans.catalog import QUERIES, Source


def enumerated(scores, moves):
    """The best sequence by trying all of them."""
    n, k = scores.shape

    def total(path):
        return sum(scores[i, y] + moves[path[i - 1] if i else k, y] for i, y in enumerate(path))

    return max(total(p) for p in itertools.product(range(k), repeat=n)), total


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    labels = tg.bio_labels(["A", "B"])
    for _ in range(60):
        lengths = np.array(sorted(rng.integers(1, 6, 3)))
        scores = np.zeros((3, lengths[-1], len(labels)))
        for i, n in enumerate(lengths):
            scores[i, :n] = rng.normal(size=(n, len(labels)))
        moves = rng.normal(size=(len(labels) + 1, len(labels))) + tg.allowed(labels)
        for path, n, s in zip(tg.viterbi(scores, moves, lengths), lengths, scores):
            best, total = enumerated(s[:n], moves)
            assert abs(total(path[:n].tolist()) - best) < 1e-9
            kept = [labels[y] for y in path[:n]]
            assert all(not y.startswith("I-") or (i and kept[i - 1][2:] == y[2:]) for i, y in enumerate(kept))


def test_unbounded_texts_and_blocks(monkeypatch):
    tagger = tg.fit([(["buy", "the", "red", "box", "now"], ["O", "O", "B-P", "I-P", "O"])] * 3, tg.bio_labels(["P"]))
    texts = [["buy", "the", "red", "box", "now"] * n for n in (1, 40, 3)] + [[]]
    whole = tagger.tag(texts)
    monkeypatch.setattr(tg, "_BLOCK_TOKENS", 10)
    assert tagger.tag(texts) == whole and [len(t) for t in whole] == [5, 200, 15, 0]
    assert whole[0] == ["O", "O", "B-P", "I-P", "O"]


@pytest.fixture(scope="module")
def split(spark):
    """Tickets without and with a name of the fifth that no list holds, and the lists."""
    source = Source(spark, "/root/testdata/sf0.001")
    names = source.names.cache()
    unlisted = names.filter((F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(5)) == 0) & ~F.col("name").isin("legal", "safety", "harbour street depot"))
    tickets = source.tickets.cache()
    gold = en.entity_mentions(tickets, unlisted, ["PRODUCT", "GPE", "ORG", "PERSON"]).cache()
    held = gold.select("ticket_id").distinct()
    return tickets.join(held, "ticket_id", "left_anti"), tickets.join(held, "ticket_id", "left_semi"), names.join(unlisted, ["name", "label"], "left_anti"), gold


def test_unlisted_names_are_found(split):
    known, held, listed, gold = split
    tagger = tg.train_tagger(known, listed)
    got = {tuple(r) for r in tg.tagged_entities(held, tagger).collect()}
    want = {tuple(r) for r in gold.collect()}
    # Listed names in the held-out tickets are no errors.
    other = {tuple(r) for r in en.gazetteer_entities(held, listed).collect()}
    hit = len(got & want)
    f1 = 2 * hit / (len(got - other) + len(want))
    assert len(want) > 100 and f1 >= 0.9, f1
    both = en.entity_mentions(held, listed, ["PRODUCT", "GPE", "ORG", "PERSON"], tagger=tagger)
    spans = [(r.ticket_id, r.start, r.end) for r in both.collect()]
    assert len({(r[0], r[1]) for r in spans}) == len(spans) and len({tuple(r) for r in both.collect()} & want) >= 0.85 * len(want)


def test_odd_rows(spark, split):
    known, _, listed, _ = split
    tagger = tg.train_tagger(known.limit(300), listed)
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "a", "x"), (5, "Does the red gizmo float? " * 2000, "x"), (5, "Does the red gizmo float?", "x"), (None, "Does the red gizmo float?", "x")]
    got = tg.tagged_entities(spark.createDataFrame(rows, "key int, body string, entity string"), tagger, "key", "body").collect()
    assert {r.key for r in got} <= {5, None} and all(r.entity for r in got)
    texts = {5: "Does the red gizmo float? " * 2000, None: "Does the red gizmo float?"}
    assert all(texts[r.key][r.start : r.end] == r.entity for r in got)
    assert tg.tagged_entities(known.limit(0), tagger).collect() == []
    nothing = tg.train_tagger(known.limit(0), listed)
    assert tg.tagged_entities(known.limit(5), nothing).collect() == []


def test_query(spark):
    rows = QUERIES["tagged_entities"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 500 and {r.entity_type for r in rows} >= {"PRODUCT", "GPE", "ORG", "PERSON"}
