"""The second sentiment score: a user model, or a linear classifier fitted on a labelled table."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values ---------------------------------------------------------------------
BATCH_SIZE = 64
MODEL_TOKENS = 512


def fit_text_classifier(
    labelled: DataFrame, text_col: str = "clean", label_col: str = "label", features: int = 1 << 14
) -> PipelineModel:
    """Words, hashed counts, rarity weights, logistic regression. Label 1 is negative, 0 positive."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_mtok", pattern=r"[\p{L}\p{N}_]+", gaps=False),
            HashingTF(inputCol="_mtok", outputCol="_mtf", numFeatures=features),
            IDF(inputCol="_mtf", outputCol="_mvec"),
            LogisticRegression(
                featuresCol="_mvec", labelCol=label_col, probabilityCol="_mprob", predictionCol="_mpred",
                rawPredictionCol="_mraw", maxIter=30, regParam=0.01,
            ),
        ]
    ).fit(labelled.select(text_col, F.col(label_col).cast("double").alias(label_col)))


def classifier_scores(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A model stage for ``analyze_sentiment``: adds model_label and the probability of that label."""

    def apply(df: DataFrame) -> DataFrame:
        keep = df.columns
        scored = model.transform(df).withColumn("_neg", vector_to_array("_mprob")[1])
        return scored.select(
            *keep,
            F.when(F.col("_neg") >= 0.5, "negative").otherwise("positive").alias("model_label"),
            F.greatest("_neg", 1 - F.col("_neg")).alias("model_score"),
        )

    return apply


def user_model_scores(
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], text_col: str = "clean", batch_size: int = BATCH_SIZE
) -> Callable[[DataFrame], DataFrame]:
    """A model stage from a Python model.

    ``load`` is called once per task and returns a function from a list of texts to (label, score) pairs. A batch that
    fails, half way or with another number of pairs than texts, falls back whole to neutral with score 0, like a text without
    a score. Only the texts are handed to Python.
    """
    kind = T.StructType([T.StructField("model_label", T.StringType()), T.StructField("model_score", T.DoubleType())])

    def answers(predict, batch: list[str]) -> list[tuple[str, float]]:
        try:
            pairs = [(label.lower(), float(score)) for label, score in predict(batch)]
        except Exception:
            pairs = []
        return pairs if len(pairs) == len(batch) else [("neutral", 0.0)] * len(batch)

    @F.arrow_udf(kind)
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = load()
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            pairs = [p for at in range(0, len(texts), batch_size) for p in answers(predict, texts[at : at + batch_size])]
            labels, scores = pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())
            yield pa.StructArray.from_arrays([labels, scores], ["model_label", "model_score"])

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumn("_model", scored(F.col(text_col))).select(*[F.col(f"`{c}`") for c in df.columns], "_model.*")

    return apply


def token_spans(pattern: str = r"\w+|[^\w\s]") -> Callable[[str], Iterable[tuple[int, int]]]:
    """Tokens as the matches of a pattern; a model's own tokenizer with offsets can take its place."""
    compiled = re.compile(pattern)
    return lambda text: (found.span() for found in compiled.finditer(text))


def token_windows(spans: Iterable[tuple[int, int]], length: int, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of windows of ``size`` tokens that overlap; the last one ends with the text. Without a token, the whole text."""
    spans = list(spans)
    if not spans:
        return [(0, length, 1)]
    starts = range(0, max(len(spans) - overlap, 1), size - overlap)
    return [(spans[i][0], spans[min(i + size, len(spans)) - 1][1], min(size, len(spans) - i)) for i in starts]


def windowed_model_scores(
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], spans: Callable[[str], Iterable[tuple[int, int]]] | None = None,
    text_col: str = "clean", size: int = MODEL_TOKENS, overlap: int = 64, batch_tokens: int = BATCH_SIZE * MODEL_TOKENS,
) -> Callable[[DataFrame], DataFrame]:
    """A model stage from a Python model of limited length, by which the whole of every text counts.

    Texts are cut into overlapping windows of ``size`` tokens; windows of like length share a batch, so that ``batch_tokens`` bounds
    windows times the longest of them. A text's label is the one with the largest sum of tokens times score, ties go to the first by
    name; its score is this sum by the tokens of all windows, so a text of one window keeps the model's score. Windows of a batch that
    fails do not count; a text without any window left is neutral with score 0. A null text is scored as an empty one.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    spans = spans or token_spans()
    kind = T.StructType([T.StructField("model_label", T.StringType()), T.StructField("model_score", T.DoubleType())])

    def batches(windows: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
        batch: list[tuple[int, int, int, int]] = []
        for window in sorted(windows, key=lambda w: w[3]):
            if batch and (len(batch) + 1) * window[3] > batch_tokens:
                yield batch
                batch = []
            batch.append(window)
        if batch:
            yield batch

    @F.arrow_udf(kind)
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = load()
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            windows = [(at, *w) for at, text in enumerate(texts) for w in token_windows(spans(text), len(text), size, overlap)]
            sums, tokens = [defaultdict(float) for _ in texts], [0] * len(texts)
            for batch in batches(windows):
                try:
                    pairs = [(label.lower(), float(score)) for label, score in predict([texts[at][start:end] for at, start, end, _ in batch])]
                except Exception:
                    continue
                if len(pairs) != len(batch):
                    continue
                for (at, _, _, n), (label, score) in zip(batch, pairs):
                    sums[at][label] += n * score
                    tokens[at] += n
            best = [min(s.items(), key=lambda p: (-round(p[1], 6), p[0])) if s else ("neutral", 0.0) for s in sums]
            labels = pa.array([label for label, _ in best], pa.string())
            scores = pa.array([s if n == 0 else s / n for (_, s), n in zip(best, tokens)], pa.float64())
            yield pa.StructArray.from_arrays([labels, scores], ["model_label", "model_score"])

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumn("_model", scored(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in df.columns], "_model.*")

    return apply
