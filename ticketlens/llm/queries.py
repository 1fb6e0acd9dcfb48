"""Queries over the given tables, one for each operator of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import langid, lexical, licenses, mixing, secrets, toxicity, warc
from ticketlens.llm.fingerprints import compare_with_next
from ticketlens.llm.frames import read, small
from ticketlens.llm.neardup import near_duplicates
from ticketlens.llm.pieces import encode_documents
from ticketlens.llm.quality import ORACLE as QUALITY_ORACLE
from ticketlens.llm.quality import quality_verdicts
from ticketlens.llm.runs import periodic_runs, plant_runs, run_digests
from ticketlens.llm.token_counts import Vocabulary, count_tokens
from ticketlens.session import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def piece_model() -> str:
    """Where the SentencePiece model lies on the machine that asks."""
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary() -> Vocabulary:
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(read(spark, folder, "documents"), byte_vocabulary)


@query
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_next(read(spark, folder, "documents"))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    labels = read(spark, folder, "labels")
    picked, counts = toxicity.pick(labels.filter(~toxicity.held_out(F.col("doc_id"))), label="toxic")
    learnt = documents.select("doc_id", "text").join(small(picked, picked.count()), F.col("doc_id") == F.col("id"))
    model = toxicity.train(learnt.select("text", "label"), true_counts=counts)
    scores = toxicity.score(documents, model)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(warc.records(read(spark, folder, "pages")), path, "gzip")
    return warc.capture_digests(warc.assemble(materialise(warc.read(spark, path), "warc-records")))


ORACLES["op4_warc_transactions"] = warc.ORACLE


@query
def op5_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    queued = mixing.queue(read(spark, folder, "documents"))
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op5_mixing_sources"] = mixing.ORACLE


@query
def op6_sentencepiece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(read(spark, folder, "documents"), piece_model)


@query
def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, folder, "documents")))


ORACLES["op7_secret_scans"] = secrets.oracle()


@query
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(read(spark, folder, "documents"))


ORACLES["op9_quality_rules"] = QUALITY_ORACLE


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    net = langid.train(documents.filter(~held_out))
    return langid.identify(documents, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", plant_runs(F.col("doc_id"), F.col("text")).alias("text"))
    return run_digests(periodic_runs(documents))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build_index(read(spark, folder, "documents")), read(spark, folder, "benchmark"))


ORACLES["op12_lexical_search"] = lexical.ORACLE


@query
def op13_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_digests(licenses.scan_licenses(read(spark, folder, "documents")))


ORACLES["op13_license_scans"] = licenses.oracle()
