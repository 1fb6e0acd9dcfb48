"""Words of topics: counts, keywords, names, similarity, merge tree. Exact for a given assignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketlens.functions import text as tx
from ticketlens.functions.wordlists import STOP_WORDS
from ticketlens.session import materialise

# --- Fixed values ---------------------------------------------------------------------
TOP_N_WORDS = 10
MIN_DF, MAX_DF = 2, 0.95
MIN_TEXT_LENGTH = 3
OUTLIER = -1
REPRESENTATIVE_DOCS = 5


def _runs(n: int) -> Column:
    """Runs of n neighbouring tokens, joined by a blank."""
    def at(token: Column, i: Column) -> Column:
        return F.when(i + n <= F.size("_tokens"), F.concat_ws(" ", F.slice("_tokens", i + 1, F.lit(n))))

    return F.array_compact(F.transform("_tokens", at))


def with_terms(
    df: DataFrame, text_col: str = "text", stop_words: Iterable[str] = STOP_WORDS, max_n: int = 2
) -> DataFrame:
    """Add ``terms``: words without stop words, and runs of up to max_n of the words left."""
    tokens = F.regexp_extract_all(F.lower(tx.fill_text(F.col(text_col))), F.lit(tx.TERM_PATTERN), F.lit(0))
    df = df.withColumn("_tokens", F.filter(tokens, lambda t: ~t.isin(list(stop_words))))
    runs = [F.col("_tokens"), *[_runs(n) for n in range(2, max_n + 1)]]
    return df.withColumn("terms", F.concat(*runs)).drop("_tokens")


def term_counts(
    df: DataFrame,
    topic_col: str = "topic",
    text_col: str = "text",
    stop_words: Iterable[str] = STOP_WORDS,
    max_n: int = 2,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    df_over: str = "documents",
) -> DataFrame:
    """(topic, term, tf, df): occurrences per topic of terms that are neither too rare nor too common.

    A sorted term array shows the first occurrence of each term within its text, so document frequency is a
    plain count beside the occurrence count and needs no distinct aggregate.
    """
    terms = with_terms(df.select(F.col(topic_col).alias("topic"), text_col), text_col, stop_words, max_n)
    terms = terms.withColumn("_sorted", F.sort_array("terms"))
    marked = F.transform(
        "_sorted",
        lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("_sorted", i - 1) != t)).alias("first")),
    )
    per_topic = (
        terms.select("topic", F.inline(marked))
        .groupBy("topic", "term")
        .agg(F.count("*").alias("tf"), F.count_if("first").alias("docs"))
    )
    by_term = W.partitionBy("term")
    if df_over == "documents":
        frequency = F.sum("docs").over(by_term)
        total = df.agg(F.count("*")).scalar()
    elif df_over == "topics":
        frequency = F.count("*").over(by_term)
        total = df.agg(F.count_distinct(topic_col)).scalar()
    else:
        raise ValueError("df_over is 'documents' or 'topics'")
    counted = per_topic.withColumn("df", frequency)
    return counted.filter((F.col("df") >= min_df) & (F.col("df") <= total * F.lit(max_df))).select("topic", "term", "tf", "df")


def c_tf_idf(counts: DataFrame) -> DataFrame:
    """(topic, term, weight) with weight = share of the term in its topic * ln(1 + mean topic size / term total)."""
    sizes = counts.groupBy("topic").agg(F.sum("tf").alias("words"))
    mean_size = sizes.agg(F.avg("words")).scalar()
    term_total = F.sum("tf").over(W.partitionBy("term"))
    weighted = counts.withColumn("total", term_total).join(sizes, "topic")
    return weighted.select(
        "topic", "term", (F.col("tf") / F.col("words") * F.log(1 + mean_size / F.col("total"))).alias("weight")
    )


def topic_keywords(weights: DataFrame, n: int = TOP_N_WORDS) -> DataFrame:
    """(topic, rank, term, weight): the n heaviest terms of each topic."""
    order = W.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("topic", "rank", "term", "weight")


def rerank_keywords(keywords: DataFrame, word_vectors: DataFrame, topic_vectors: DataFrame) -> DataFrame:
    """Order the keywords of each topic by closeness of word and topic vectors.

    ``word_vectors`` is (term, vector), ``topic_vectors`` (topic, vector); terms without a vector go last.
    """
    from ticketlens.functions.arrays import cosine

    scored = (
        keywords.join(word_vectors.select("term", F.col("vector").alias("_w")), "term", "left")
        .join(topic_vectors.select("topic", F.col("vector").alias("_t")), "topic", "left")
        .withColumn("closeness", cosine(F.col("_w"), F.col("_t")))
    )
    order = W.partitionBy("topic").orderBy(F.desc_nulls_last("closeness"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).select("topic", "rank", "term", "weight", "closeness")


def topic_frequencies(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("topic").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "topic")


def topic_outliers(assignment: DataFrame) -> DataFrame:
    return assignment.agg(F.count_if(F.col("topic") == OUTLIER).alias("n_outliers"))


def topic_info(assignment: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, count, name, keywords): the name is the number and the four leading words."""
    words = keywords.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords")
    )
    counts = assignment.groupBy("topic").agg(F.count("*").alias("count"))
    joined = counts.join(words, "topic", "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>"))
    )
    name = F.concat_ws("_", F.array(F.col("topic").cast("string")), F.slice("keywords", 1, 4))
    return joined.select("topic", "count", name.alias("name"), "keywords")


def topic_summary(info: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """Topic info without outliers, with example texts; missing names and counts are filled."""
    out = info.filter(F.col("topic") != OUTLIER)
    if representative is not None:
        docs = representative.groupBy("topic").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("representative_docs")
        )
        out = out.join(docs, "topic", "left")
    else:
        out = out.withColumn("representative_docs", F.lit(None).cast("array<string>"))
    return out.select(
        "topic",
        F.coalesce("name", F.concat(F.lit("Topic_"), F.col("topic").cast("string"))).alias("name"),
        "keywords",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("representative_docs", F.array().cast("array<string>")).alias("representative_docs"),
    )


def topic_bar_data(keywords: DataFrame, n_topics: int = 8, n_words: int = 8) -> DataFrame:
    return keywords.filter((F.col("topic") >= 0) & (F.col("topic") < n_topics) & (F.col("rank") <= n_words))


def topic_similarity(weights: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity) with a <= b, for topics that share a term: cosine of their term vectors.

    Terms are spread over the tasks; every task adds its terms into one topics x topics matrix, and only
    these matrices are shuffled. No pair of rows is formed per term.
    """
    vectors = weights.groupBy("term").agg(F.collect_list("topic").alias("topics"), F.collect_list("weight").alias("weights"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[int, int] = {}
        total = np.zeros((0, 0))
        for batch in batches:
            for topic in np.unique(np.concatenate(batch["topics"].tolist())) if len(batch) else ():
                place.setdefault(int(topic), len(place))
            grown = np.zeros((len(place), len(place)))
            grown[: len(total), : len(total)] = total
            matrix = np.zeros((len(batch), len(place)))
            for row, (ts, ws) in enumerate(zip(batch["topics"], batch["weights"])):
                matrix[row, [place[int(t)] for t in ts]] = ws
            total = grown + matrix.T @ matrix
        names = np.array(list(place), dtype="int64")
        a, b = np.nonzero((names[:, None] <= names[None, :]) & (total > 0))
        yield pd.DataFrame({"topic_a": names[a], "topic_b": names[b], "dot": total[a, b]})

    dots = vectors.mapInPandas(gram, "topic_a bigint, topic_b bigint, dot double").groupBy("topic_a", "topic_b").agg(F.sum("dot").alias("dot"))
    norms = dots.filter("topic_a = topic_b").select(F.col("topic_a").alias("t"), F.sqrt("dot").alias("norm"))
    left = norms.select(F.col("t").alias("topic_a"), F.col("norm").alias("norm_a"))
    right = norms.select(F.col("t").alias("topic_b"), F.col("norm").alias("norm_b"))
    return dots.join(left, "topic_a").join(right, "topic_b").select(
        "topic_a", "topic_b", (F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("similarity")
    )


def _merges(similarity: DataFrame) -> DataFrame:
    """(step, a, b, distance): average-linkage merges of clusters, each named by its smallest topic, a < b.

    Two clusters that are nearest to each other merge in any order of merging, so every round merges all such pairs at once:
    a few joins and aggregates over the pairs that share a term. Pairs without a row have a cosine of 0, a distance of 1;
    only what distances differ from 1 is kept and summed. Equal distances go by the smaller, then the larger name.
    """
    known = similarity.filter("topic_a >= 0").select("topic_a", "topic_b", "similarity")
    sizes = known.select(F.col("topic_a").alias("key")).union(known.select("topic_b")).distinct().withColumn("size", F.lit(1).cast("bigint"))
    apart = known.filter("topic_a <> topic_b").withColumn("less", F.round("similarity", 9))
    pairs = apart.select(F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), "less").union(apart.select("topic_b", "topic_a", "less"))
    sizes, pairs = materialise(sizes, "merge-sizes"), materialise(pairs, "merge-pairs")
    done: DataFrame | None = None
    turn = 0
    while True:
        turn += 1
        mean = F.round(1 - F.col("less") / (F.col("na") * F.col("nb")), 9)
        measured = (
            pairs.join(sizes.select(F.col("key").alias("a"), F.col("size").alias("na")), "a")
            .join(sizes.select(F.col("key").alias("b"), F.col("size").alias("nb")), "b").withColumn("distance", mean).filter("distance < 1")
        )
        nearest = measured.groupBy("a").agg(F.min(F.struct("distance", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "b")).alias("m"))
        nearest = nearest.select("a", "m.b", "m.distance")
        other = nearest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merged = materialise(nearest.filter("a < b").join(other, ["a", "b"]).select(F.lit(turn).alias("turn"), "a", "b", "distance"), "merge-round")
        if merged.isEmpty():
            break
        done = merged if done is None else done.union(merged)
        to = merged.select(F.col("b").alias("old"), F.col("a").alias("new"))

        def renamed(df: DataFrame, key: str) -> DataFrame:
            return df.join(to, F.col(key) == F.col("old"), "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")

        sizes = materialise(renamed(sizes, "key").groupBy("key").agg(F.sum("size").alias("size")), "merge-sizes")
        pairs = materialise(renamed(renamed(pairs, "a"), "b").filter("a <> b").groupBy("a", "b").agg(F.sum("less").alias("less")), "merge-pairs")
    # What is left has nothing in common: everything joins the smallest, in order.
    first = sizes.agg(F.min("key")).scalar()
    rest = sizes.select(F.lit(turn).alias("turn"), first.alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("distance")).filter("a < b")
    done = rest if done is None else done.union(rest)
    return done.select(F.row_number().over(W.orderBy("distance", "turn", "a", "b")).alias("step"), "a", "b", "distance")


def topic_hierarchy(similarity: DataFrame) -> DataFrame:
    """(step, parent_id, left_id, right_id, distance): the merge tree. New nodes are numbered on from the largest topic."""
    merges = materialise(_merges(similarity), "merges")
    largest = similarity.filter("topic_a >= 0").agg(F.greatest(F.max("topic_a"), F.max("topic_b"))).scalar()
    last = merges.groupBy(F.col("a").alias("b")).agg(F.max("step").alias("own"))
    before = F.lag("step").over(W.partitionBy("a").orderBy("step"))
    return merges.withColumn("before", before).join(last, "b", "left").withColumn("largest", largest).select(
        "step", (F.col("largest") + F.col("step")).cast("bigint").alias("parent_id"),
        F.coalesce(F.col("largest") + F.col("before"), F.col("a")).cast("bigint").alias("left_id"),
        F.coalesce(F.col("largest") + F.col("own"), F.col("b")).cast("bigint").alias("right_id"), "distance",
    )


def reduce_topics(assignment: DataFrame, similarity: DataFrame, n_topics: int) -> DataFrame:
    """Follow the merge tree until n_topics are left and renumber by size; outliers stay outliers."""
    merges = materialise(_merges(similarity), "merges")
    steps = max(merges.count() + 1 - n_topics, 0)
    mapping = materialise(merges.filter(F.col("step") <= steps).select(F.col("b").alias("old"), F.col("a").alias("new")), "merge-map")
    while True:  # the name of the name, until names stay
        on = mapping.select(F.col("old").alias("new"), F.col("new").alias("far"))
        mapping = materialise(mapping.join(on, "new", "left").select("old", F.coalesce("far", "new").alias("new"), F.col("far").isNotNull().alias("moved")), "merge-map")
        if mapping.filter("moved").isEmpty():
            break
        mapping = mapping.select("old", "new")
    kind = assignment.schema["topic"].dataType
    mapping = mapping.select(F.col("old").cast(kind).alias("topic"), F.col("new").cast(kind).alias("_new"))
    merged = assignment.join(mapping, "topic", "left").withColumn("topic", F.coalesce("_new", "topic")).drop("_new")
    return renumber_by_size(merged.select(*assignment.columns))


def renumber_by_size(assignment: DataFrame, min_size: int = 1) -> DataFrame:
    """0 is the largest topic; groups below min_size and negative numbers become -1."""
    sizes = assignment.filter("topic >= 0").groupBy("topic").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    order = sizes.select("topic", (F.row_number().over(W.orderBy(F.desc("_n"), "topic")) - 1).alias("_rank"))
    return assignment.join(order, "topic", "left").withColumn("topic", F.coalesce("_rank", F.lit(OUTLIER))).select(*assignment.columns)


def topic_word_counts(
    topics: DataFrame,
    texts: DataFrame | None = None,
    n_topics: int = 6,
    n_words: int = 50,
    label_col: str = "topic_label",
    text_col: str = "text",
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """(topic_label, rank, word, count): frequent words of the largest topics."""
    largest = (
        topics.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), label_col).limit(n_topics)
    )
    chosen = topics.join(largest.select(label_col), label_col, "left_semi")
    if texts is not None:
        chosen = chosen.drop(text_col).join(texts.select("ticket_id", text_col), "ticket_id", "left")
    words = with_terms(chosen.select(label_col, text_col), text_col, stop_words, max_n=1)
    counts = words.select(F.col(label_col).alias("topic_label"), F.explode_outer("terms").alias("word")).filter("word is not null").groupBy("topic_label", "word").agg(
        F.count("*").alias("count")
    )
    order = W.partitionBy("topic_label").orderBy(F.desc("count"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_words).select(
        "topic_label", "rank", "word", "count"
    )
