import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from ticketlens.llm.queries import byte_vocabulary
from ticketlens.llm.token_counts import allocate, count_tokens, load, parts_of

SCHEMA = "doc_id bigint, title string, text string, field string, n_tokens string"


def brute(values, names, lines, rule):
    """One byte after the other: the part and the token that it belongs to."""
    parts = parts_of([v or "" for v in values], lines)
    encoding, _ = load(byte_vocabulary())
    tokens = encoding.encode_ordinary("".join(p for *_, p in parts))
    owner = [k for k, (*_, p) in enumerate(parts) for _ in p.encode()]
    out = [[0, 0, 0.0] for _ in parts]
    at = 0
    for t in tokens:
        size = len(encoding.decode_single_token_bytes(t))
        mine = owner[at : at + size]
        assert len(mine) == size
        shares = {k: mine.count(k) for k in dict.fromkeys(mine)}
        out[mine[0] if rule == "first" else max(shares, key=lambda k: (shares[k], -k))][0] += 1
        for k, n in shares.items():
            out[k][1] += len(shares) > 1
            out[k][2] += n / size
        at += size
    assert at == len(owner)
    place, rows = 0, []
    for (f, k, p), (n, c, s) in zip(parts, out):
        rows.append(("(between)" if f < 0 else names[f], k, place, place + len(p), n, c, round(s, 9)))
        place += len(p)
    return rows


def documents():
    rnd = random.Random(2)
    units = ["the ", "\n", "\n\n", "  ", "token", "é", "日本", "🙂", "\n \n", "...", "x", "\t\n"]
    rows = [(i, rnd.choice([None, "a title", "", "t\n"]), "".join(rnd.choices(units, k=rnd.randint(0, 60)))) for i in range(60)]
    return rows + [(7, "twice", "same\n\nrow"), (7, "twice", "same\n\nrow"), (None, None, None), (8, "long", "word and word\n" * 20_000)]


@pytest.mark.parametrize("names,lines,rule", [(("text",), True, "most"), (("title", "text"), False, "first"), (("title", "text"), True, "most")])
def test_against_bytes(spark, names, lines, rule):
    docs = spark.createDataFrame([(*r, "f", "n") for r in documents()], SCHEMA)
    got = [(*tuple(r)[:-1], round(r.token_share, 9)) for r in count_tokens(docs, byte_vocabulary, names, lines, rule).collect()]
    want = [(i, *row) for i, title, text in documents() for row in brute([title, text][2 - len(names):], names, lines, rule)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rules():
    ends, borders = np.array([2, 7, 8]), np.array([0, 3, 3, 5, 8])  # the second token covers bytes 2 to 6
    assert allocate(ends, borders, "first")[0].tolist() == [2, 0, 0, 1]
    assert allocate(ends, borders, "most")[0].tolist() == [1, 0, 1, 1]
    assert allocate(ends, borders, "most")[1].tolist() == [1, 0, 1, 1]
    assert allocate(ends, borders, "most")[2] == pytest.approx([1.2, 0, 0.4, 1.4])


def test_spans_equal_the_offsets_of_another_library():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    encoding, sizes = load(byte_vocabulary())
    for text in ("Plain words, and  more.\n\nLines", "don't stop at 12345", "café résumé"):
        tokens = encoding.encode_ordinary(text)
        got = other.encode(text, add_special_tokens=False)
        assert tokens == got.ids
        if text.isascii():
            ends = np.cumsum(sizes[tokens]).tolist()
            assert [e for _, e in got.offsets] == ends


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], SCHEMA), byte_vocabulary).collect() == []
    with pytest.raises(ValueError):
        count_tokens(spark.createDataFrame([], SCHEMA), byte_vocabulary, rule="none")
