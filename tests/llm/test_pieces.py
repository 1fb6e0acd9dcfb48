import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from ticketlens.llm.pieces import PieceEncoder, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def own():
    return PieceEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(own, library, text):
    want = library.encode(text, add_eos=True)
    got = own.encode(text)
    assert got == want, repr(text[:200])
    assert own.decode(got) == library.decode(want), repr(text[:200])
    assert own.digest(text)[0] == len(want) and own.digest(text)[3] == " ".join(map(str, want))


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a", " a ", "\n", "\t x", "<s> </s> <unk>", "<0x0A>", "▁", "▁x▁▁ y", "日本語 テスト", "\x00a", "ﬁ Å", "é" * 60, "=" * 90,
    "🙂🙂 hi", "    def f(x):\n        return x\n", "    　", "word " * 3000,
])
def test_texts(own, library, text):
    same(own, library, text)


def test_runs_of_blanks(own, library):
    for n in range(80):
        for text in (" " * n, " " * n + "word", "x" + " " * n + "日", " " * n + "\n" + " " * n):
            same(own, library, text)


@pytest.mark.parametrize("alphabet", ["aeinrst ", "abcdefgh THE ing .,-é日\n01▁ß🙂 ", None])
def test_random_texts(own, library, alphabet):
    rnd = random.Random(4)
    units = list(alphabet) if alphabet else [p.replace("▁", " ") for p in own.ids]
    for _ in range(3000):
        same(own, library, "".join(rnd.choices(units, k=rnd.randint(1, 30))))


def test_decoding_any_ids(own, library):
    rnd = random.Random(5)
    for _ in range(3000):
        ids = rnd.choices([*range(3, 259), *rnd.sample(range(259, 32000), 40)], k=rnd.randint(0, 12))
        assert own.decode(ids) == library.decode(ids), ids


def test_forgetting_changes_nothing(own, library, monkeypatch):
    small = PieceEncoder(PATH)
    small.memo.limit = small.parts.limit = 3
    for text in ("one two three four five one two", "five four three two one", "one, two. three"):
        same(small, library, text)


def test_documents(spark, library, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(1, None), (None, ""), (1, "x"), (1, "x")]
    frame = spark.createDataFrame([(*r, None, "1") for r in rows], SCHEMA)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *shas))
    assert sorted((tuple(r) for r in encode_documents(frame, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert encode_documents(frame.limit(0), PATH, with_ids=True).collect() == []


def test_decoded_text_is_that_of_the_ids(own, library):
    for text in ("one two", "日本語 x", "é🙂 a  b", " ▁x", "", None):
        n, _, decoded, ids = own.digest(text)
        assert decoded == hashlib.sha256(library.decode([int(i) for i in ids.split(" ")]).encode()).hexdigest()
    broken = PieceEncoder(PATH)
    broken.memo["one"] = broken.memo["three"]
    assert broken.digest("one two")[2] == hashlib.sha256(b"three two").hexdigest()
