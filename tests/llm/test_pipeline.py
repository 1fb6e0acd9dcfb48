import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_neardup import brute as groups
from test_quality import brute as quality
from test_secrets import brute as secret_spans

from ticketlens.llm.mixing import queue


def redacted(text):
    _, spans = secret_spans(text)
    parts, upto = [], 0
    for a, _, _, b in spans:
        if a > upto or not parts:
            parts += [text[upto:a], "[SECRET]"]
        upto = max(upto, b)
    return "".join(parts) + text[upto:]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.asDict() for r in docs.collect()}

    good = corpus_pipeline.quality_rules(spark, docs, folder)
    want = {i for i, r in rows.items() if not quality(r["text"])[-1]}
    assert good.columns == columns and {r.doc_id for r in good.collect()} <= want
    want = {r.doc_id for r in good.collect()}

    alone = corpus_pipeline.near_dedup(spark, good, folder)
    kept = {i for i, _, _, keep in groups([(i, rows[i]["text"]) for i in sorted(want)]) if keep}
    assert alone.columns == columns and sorted(r.doc_id for r in alone.collect()) == sorted(kept)

    clean = corpus_pipeline.secret_scans(spark, alone, folder)
    assert clean.columns == columns
    got = {r.doc_id: r for r in clean.collect()}
    assert set(got) == kept and all(got[i].text == redacted(rows[i]["text"]) for i in kept)

    mixed = corpus_pipeline.mixing(spark, clean, folder)
    copies = {r.doc_id: r.copies for r in queue(clean).collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.encoding(spark, mixed, folder).collect():
        assert r.ids == " ".join(map(str, library.encode(got[r.doc_id].text, add_eos=True)))
        assert r.decoded_sha256 == hashlib.sha256(got[r.doc_id].text.replace("▁", " ").encode()).hexdigest()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 20
