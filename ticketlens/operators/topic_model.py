"""Learned topics: vectors, reduction, clustering, prediction. MLlib does the fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import text as tx
from ticketlens.functions.arrays import cosine
from ticketlens.operators import topics as tp
from ticketlens.session import materialise, scratch_root

# --- Fixed values ---------------------------------------------------------------------
N_COMPONENTS = 5
MIN_CLUSTER_SIZE = 10
MIN_SAMPLES = 5
SEED = 42


def fit_embedder(df: DataFrame, text_col: str = "text", dimensions: int = 512) -> PipelineModel:
    """Hashed words weighted by rarity; adds ``vector``. Expects the ``terms`` array of ``with_terms``."""
    return Pipeline(
        stages=[
            HashingTF(inputCol="terms", outputCol="_tf", numFeatures=dimensions),
            IDF(inputCol="_tf", outputCol="vector", minDocFreq=2),
        ]
    ).fit(tp.with_terms(df, text_col, max_n=1))


def embed(df: DataFrame, model: PipelineModel, text_col: str = "text") -> DataFrame:
    return model.transform(tp.with_terms(df, text_col, max_n=1)).drop("_tf", "terms")


def embed_with(df: DataFrame, predict, text_col: str = "text", batch_size: int = 64) -> DataFrame:
    """Add ``embedding`` from a user model: ``predict`` is a factory as for ``predict_batch_udf``."""
    from pyspark.ml.functions import predict_batch_udf

    encode = predict_batch_udf(predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", encode(F.col(text_col)))


def fit_reducer(df: DataFrame, vector_col: str = "vector", k: int = N_COMPONENTS) -> PipelineModel:
    """Unit length, which makes Euclidean distance follow the cosine, then principal components."""
    return Pipeline(
        stages=[Normalizer(inputCol=vector_col, outputCol="_unit"), PCA(k=k, inputCol="_unit", outputCol="reduced")]
    ).fit(df)


def reduce_dims(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).drop("_unit")


def fit_clusters(df: DataFrame, ks: Sequence[int] = (5, 10, 20), method: str = "kmeans", vector_col: str = "reduced"):
    """The clustering with the best silhouette among a few numbers of clusters."""
    make = {"kmeans": KMeans, "bisecting": BisectingKMeans}[method]
    evaluator = ClusteringEvaluator(featuresCol=vector_col, predictionCol="_cluster")
    best = None
    for k in ks:
        model = make(k=k, seed=SEED, featuresCol=vector_col, predictionCol="_cluster").fit(df)
        score = evaluator.evaluate(model.transform(df)) if len(ks) > 1 else 0.0
        if best is None or score > best[0]:
            best = (score, model)
    return best[1]


def cluster_topics(
    df: DataFrame, model, id_col: str = "ticket_id", min_cluster_size: int = MIN_CLUSTER_SIZE
) -> DataFrame:
    """(id, topic): 0 is the largest cluster, clusters below the minimum size become -1."""
    # Written, as both the sizes and the new numbers are taken from it: texts are not turned into vectors twice.
    assigned = materialise(model.transform(df).select(id_col, F.col("_cluster").alias("topic")), "clusters")
    return tp.renumber_by_size(assigned, min_cluster_size)


def density_topics(
    df: DataFrame,
    cell: float,
    id_col: str = "ticket_id",
    vector_col: str = "reduced",
    min_samples: int = MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
) -> DataFrame:
    """(id, topic) from connected dense grid cells; points elsewhere are -1.

    Points are counted per cell before anything else, so a region that holds most of the data is one row.
    Neighbours are found by an equi-join on the cells that share a face, and components by passing the
    smallest cell number along until nothing changes.
    """
    scratch_root(df.sparkSession)
    cells = F.transform(vector_to_array(vector_col), lambda x: F.floor(x / cell))
    points = df.select(id_col, cells.alias("cell"))
    dense = (
        points.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_samples)
        .select("cell", F.array_join("cell", ",").alias("label")).checkpoint()
    )
    steps = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("cell") - 1),
            lambda d: F.transform(
                F.array(F.lit(-1), F.lit(1)),
                lambda s: F.transform("cell", lambda x, i: F.when(i == d, x + s).otherwise(x)),
            ),
        )
    )
    edges = dense.select("cell", F.explode(steps).alias("other")).join(dense.select(F.col("cell").alias("other")), "other", "left_semi").checkpoint()
    labels = dense
    while True:
        around = edges.join(labels.select(F.col("cell").alias("other"), F.col("label").alias("near")), "other")
        best = around.groupBy("cell").agg(F.min("near").alias("near"))
        moved = labels.join(best, "cell", "left").select(
            "cell", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old")
        )
        # Jump to the label of the cell that the label names: paths shorten by half each time.
        roots = moved.select(F.array_join("cell", ",").alias("label"), F.col("label").alias("root"))
        step = moved.join(roots, "label", "left").select(
            "cell", F.least("label", F.coalesce("root", "label")).alias("label"), "old"
        ).checkpoint()
        labels = step.select("cell", "label")
        if step.filter("label <> old").isEmpty():
            break
    numbered = points.join(labels, "cell", "left").select(id_col, "label")
    sizes = numbered.filter("label is not null").groupBy("label").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_cluster_size)
    order = sizes.select("label", (F.row_number().over(W.orderBy(F.desc("_n"), "label")) - 1).alias("topic"))
    return numbered.join(order, "label", "left").select(id_col, F.coalesce("topic", F.lit(tp.OUTLIER)).alias("topic"))


class TopicModel:
    """The fitted stages of ``fit_topics``: applying them is row-local."""

    def __init__(self, embedder: PipelineModel, reducer: PipelineModel, clusters):
        self.embedder, self.reducer, self.clusters = embedder, reducer, clusters

    def vectors(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return reduce_dims(embed(df, self.embedder, text_col), self.reducer)


def _hashed(df: DataFrame, text_col: str, dimensions: int, *keep: str) -> tuple[HashingTF, DataFrame]:
    """The counts of hashed words, which take a pass over the texts; weights, vectors and clusters follow from them."""
    hashing = HashingTF(inputCol="terms", outputCol="_tf", numFeatures=dimensions)
    return hashing, hashing.transform(tp.with_terms(tp_texts(df, text_col), text_col, max_n=1)).select(*keep, "_tf")


def _fit(hashing: HashingTF, counted: DataFrame, ks: Sequence[int], n_components: int) -> TopicModel:
    weights = IDF(inputCol="_tf", outputCol="vector", minDocFreq=2).fit(counted)
    vectors = weights.transform(counted).select("vector")
    reducer = fit_reducer(vectors, "vector", n_components)
    reduced = reduce_dims(vectors, reducer).select("reduced").persist()
    try:
        return TopicModel(PipelineModel([hashing, weights]), reducer, fit_clusters(reduced, ks))
    finally:
        reduced.unpersist()


def fit_topics(
    df: DataFrame, text_col: str = "text", ks: Sequence[int] = (5, 10, 20), n_components: int = N_COMPONENTS, dimensions: int = 512
) -> TopicModel:
    hashing, counted = _hashed(df, text_col, dimensions)
    counted = counted.persist()
    try:
        return _fit(hashing, counted, ks, n_components)
    finally:
        counted.unpersist()


def tp_texts(df: DataFrame, text_col: str) -> DataFrame:
    return tx.min_length(df, tp.MIN_TEXT_LENGTH, text_col)


def assign_topics(
    df: DataFrame, model: TopicModel, id_col: str = "ticket_id", text_col: str = "text", min_cluster_size: int = MIN_CLUSTER_SIZE
) -> DataFrame:
    """(id, topic) for every row of the table; short texts get -1."""
    vectors = model.vectors(tp_texts(df.select(id_col, text_col), text_col), text_col)
    found = cluster_topics(vectors, model.clusters, id_col, min_cluster_size)
    return df.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("topic", F.lit(tp.OUTLIER)).alias("topic"))


def topic_centroids(df: DataFrame, topic_col: str = "topic", embedding_col: str = "embedding") -> DataFrame:
    """(topic, centroid): mean vector per topic, outliers left out. Sums are combined before the shuffle."""
    vector = array_to_vector(F.col(embedding_col).cast("array<double>"))
    return (
        df.filter(F.col(topic_col) != tp.OUTLIER).groupBy(F.col(topic_col).alias("topic"))
        .agg(vector_to_array(Summarizer.mean(vector)).alias("centroid"))
    )


# Products of vectors and centroids that a task holds at a time.
_CELLS = 4_000_000


def _model_rows(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Topics and unit centroids: the model, which every task needs whole."""
    rows = centroids.orderBy("topic").collect()
    if not rows:
        raise ValueError("no topics to compare with")
    matrix = np.array([r["centroid"] for r in rows], dtype="float64")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.array([r["topic"] for r in rows], dtype="int32"), matrix / np.where(norms > 0, norms, 1)


def _directions(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have a direction: neither null nor zero nor with a null in them."""
    usable = np.array([v is not None and len(v) == width and None not in v for v in vectors.to_pylist()], bool)
    x = np.zeros((len(vectors), width))
    if usable.any():
        x[usable] = np.asarray(vectors.filter(pa.array(usable)).flatten(), dtype="float64").reshape(-1, width)
    norms = np.linalg.norm(x, axis=1)
    return x / np.where(norms > 0, norms, 1)[:, None], usable & (norms > 0)


def _blocks(x: np.ndarray, unit: np.ndarray):
    step = max(1, _CELLS // len(unit))
    for at in range(0, len(x), step):
        yield slice(at, at + step), x[at : at + step] @ unit.T


def closest_topic(df: DataFrame, centroids: DataFrame, embedding_col: str = "embedding") -> DataFrame:
    """Add ``topic``, ``similarity`` and ``probability`` (softmax over topics of the cosine).

    The centroids are the model and go to the tasks as one matrix; a block of vectors is one product. Null and zero
    vectors get topic -1, similarity and probability 0.
    """
    names, unit = _model_rows(centroids)

    @F.arrow_udf("struct<topic:int,similarity:double,probability:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        x, usable = _directions(vectors, unit.shape[1])
        topic, similarity, probability = np.full(len(x), tp.OUTLIER, "int32"), np.zeros(len(x)), np.zeros(len(x))
        for part, sims in _blocks(x, unit):
            best = sims.argmax(axis=1)
            top = sims[np.arange(len(best)), best]
            topic[part], similarity[part], probability[part] = names[best], top, np.exp(top) / np.exp(sims).sum(axis=1)
        columns = [np.where(usable, topic, tp.OUTLIER).astype("int32"), np.where(usable, similarity, 0.0), np.where(usable, probability, 0.0)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["topic", "similarity", "probability"])

    return df.withColumn("_near", nearest(F.col(embedding_col))).select("*", "_near.*").drop("_near")


def topic_probability(df: DataFrame, centroids: DataFrame, topic_col: str, embedding_col: str = "embedding") -> DataFrame:
    """Add ``probability``: softmax over topics of the cosine, taken at the assigned topic; 0 for null and zero vectors and for
    topics without a centroid."""
    names, unit = _model_rows(centroids)

    @F.arrow_udf("double")
    def confidence(vectors: pa.Array, topics: pa.Array) -> pa.Array:
        x, usable = _directions(vectors, unit.shape[1])
        own = np.array([tp.OUTLIER if t is None else t for t in topics.to_pylist()])
        at = np.clip(np.searchsorted(names, own), 0, len(names) - 1)
        out = np.zeros(len(x))
        for part, sims in _blocks(x, unit):
            odds = np.exp(sims)
            out[part] = odds[np.arange(len(odds)), at[part]] / odds.sum(axis=1)
        return pa.array(np.where(usable & (names[at] == own), out, 0.0))

    return df.withColumn("probability", confidence(F.col(embedding_col), F.col(topic_col)))


def representative_docs(
    df: DataFrame, centroids: DataFrame, topic_col: str = "topic", id_col: str = "ticket_id",
    embedding_col: str = "embedding", n: int = tp.REPRESENTATIVE_DOCS,
) -> DataFrame:
    """(topic, rank, id, similarity): the n members closest to the centroid of their own topic.

    Centroids are joined by topic. Only id and similarity are ranked; each task cuts to n per topic before the shuffle.
    Null and zero vectors, and topics without a centroid, have similarity 0.
    """
    own = centroids.select(F.col("topic").alias(topic_col), "centroid")
    members = df.filter(F.col(topic_col) != tp.OUTLIER).select(topic_col, id_col, F.col(embedding_col).alias("_vector")).join(own, topic_col, "left")
    usable = F.exists("_vector", lambda x: x != 0) & F.exists("centroid", lambda x: x != 0)
    similarity = F.coalesce(F.when(usable, cosine(F.col("_vector"), F.col("centroid"))), F.lit(0.0))
    ranked = members.select(F.col(topic_col).alias("topic"), id_col, F.round(similarity, 9).alias("similarity"))
    order = W.partitionBy("topic").orderBy(F.desc("similarity"), id_col)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("topic", "rank", id_col, "similarity")


def predict_topics(
    df: DataFrame, centroids: DataFrame, keywords: DataFrame, id_col: str = "ticket_id",
    text_col: str = "text", embedding_col: str = "embedding",
) -> DataFrame:
    """(id, topic, keywords, probability) for a table of new texts; short ones get -1, none and 0."""
    usable = df.filter(tx.long_enough(F.col(text_col), tp.MIN_TEXT_LENGTH) & F.col(embedding_col).isNotNull())
    found = closest_topic(usable.select(id_col, embedding_col), centroids, embedding_col).select(id_col, "topic", "probability")
    words = keywords.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords")
    )
    return (
        df.select(id_col).join(found, id_col, "left").join(words, "topic", "left")
        .select(
            id_col, F.coalesce("topic", F.lit(tp.OUTLIER)).alias("topic"),
            F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
            F.coalesce("probability", F.lit(0.0)).alias("probability"),
        )
    )


def topic_map(centroids: DataFrame) -> DataFrame:
    """(topic, x, y): two principal components of the centroids, for a map of topics."""
    vectors = centroids.select("topic", array_to_vector(F.col("centroid").cast("array<double>")).alias("vector"))
    flat = fit_reducer(vectors, "vector", 2).transform(vectors).select("topic", vector_to_array("reduced").alias("xy"))
    return flat.select("topic", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
