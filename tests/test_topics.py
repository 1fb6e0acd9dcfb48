import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ticketlens.operators import topic_model as tm
from ticketlens.operators import topics as tp


def test_terms_skip_stop_words_before_joining(spark):
    df = spark.createDataFrame([("The parcel of the Shop was late",), (None,), ("a b",)], "text string")
    assert [r["terms"] for r in tp.with_terms(df).collect()] == [["parcel", "shop", "late", "parcel shop", "shop late"], [], []]


def test_document_frequency_limits(spark):
    texts = [("0", "common apple apple"), ("0", "common apple"), ("1", "common pear"), ("1", "common plum"), ("1", "other pear")] * 1
    df = spark.createDataFrame(texts, "topic string, text string")
    got = {(r["topic"], r["term"]): (r["tf"], r["df"]) for r in tp.term_counts(df, max_df=0.75).collect()}
    assert got == {
        ("0", "apple"): (3, 2), ("1", "pear"): (2, 2), ("0", "common apple"): (2, 2),
    }
    over_topics = {r["term"] for r in tp.term_counts(df, max_df=1.0, df_over="topics").collect()}
    assert over_topics == {"common"}
    with pytest.raises(ValueError):
        tp.term_counts(df, df_over="words")


def test_keywords_names_and_summary(spark):
    rows = [(0, "billing invoice invoice refund")] * 3 + [(1, "parcel courier parcel lost")] * 2 + [(-1, "noise noise")] * 2
    df = spark.createDataFrame(rows, "topic int, text string")
    keywords = tp.topic_keywords(tp.c_tf_idf(tp.term_counts(df)))
    info = tp.topic_info(df, keywords)
    by_topic = {r["topic"]: r for r in info.collect()}
    assert by_topic[0]["count"] == 3 and by_topic[0]["name"].startswith("0_invoice") and len(by_topic[0]["keywords"]) <= 10
    summary = tp.topic_summary(info).collect()
    assert {r["topic"] for r in summary} == {0, 1} and all(r["representative_docs"] == [] for r in summary)


def test_similarity_of_unrelated_topics_and_tree(spark):
    weights = spark.createDataFrame(
        [(0, "a", 1.0), (0, "b", 1.0), (1, "a", 1.0), (1, "b", 1.1), (2, "z", 1.0), (3, "z", 2.0), (3, "a", 0.1)],
        "topic int, term string, weight double",
    )
    sims = tp.topic_similarity(weights)
    got = {(r["topic_a"], r["topic_b"]): r["similarity"] for r in sims.collect()}
    assert got[(2, 2)] == pytest.approx(1) and (0, 2) not in got and got[(0, 1)] > 0.99
    tree = tp.topic_hierarchy(sims).orderBy("step").collect()
    assert [(r["left_id"], r["right_id"]) for r in tree] == [(2, 3), (0, 1), (4, 5)] or [(r["left_id"], r["right_id"]) for r in tree] == [(0, 1), (2, 3), (4, 5)]
    assigned = spark.createDataFrame([(str(i), t) for i, t in enumerate([0, 0, 0, 1, 2, 3, -1])], "ticket_id string, topic int")
    reduced = {r["ticket_id"]: r["topic"] for r in tp.reduce_topics(assigned, sims, 2).collect()}
    assert reduced == {"0": 0, "1": 0, "2": 0, "3": 0, "4": 1, "5": 1, "6": -1}

def brute_tree(n, pairs):
    clusters = {t: [t] for t in range(n)}
    out = []

    def mean(a, b):
        less = sum(round(pairs.get((min(x, y), max(x, y)), 0.0), 9) for x in clusters[a] for y in clusters[b])
        return round(1 - less / (len(clusters[a]) * len(clusters[b])), 9)

    node = {t: t for t in range(n)}
    while len(clusters) > 1:
        d, a, b = min((mean(a, b), a, b) for a in clusters for b in clusters if a < b)
        out.append((len(out) + 1, n + len(out), node[a], node[b], d))
        node[a] = n + len(out) - 1
        clusters[a] += clusters.pop(b)
    return out


def test_tree_equals_brute_force(spark):
    rng = random.Random(4)
    pairs = {(a, b): rng.random() * 0.9 for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2 and a < 27}
    rows = [(t, t, 1.0) for t in range(30)] + [(a, b, s) for (a, b), s in pairs.items()]
    sims = spark.createDataFrame(rows, "topic_a bigint, topic_b bigint, similarity double")
    got = [tuple(r) for r in tp.topic_hierarchy(sims).orderBy("step").collect()]
    want = brute_tree(30, pairs)
    assert [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-9)


def test_renumber_by_size(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([7, 7, 7, 3, 3, 9, -1])], "ticket_id int, topic int")
    got = [r["topic"] for r in tp.renumber_by_size(df, 2).orderBy("ticket_id").collect()]
    assert got == [0, 0, 0, 1, 1, -1, -1]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(1)
    centres = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    rows = [(f"{k}-{i}", k, [c + rng.gauss(0, 0.05) for c in centre]) for k, centre in enumerate(centres) for i in range(60 - 10 * k)]
    return spark.createDataFrame(rows, "ticket_id string, topic int, embedding array<double>")


def purity(df):
    best = df.groupBy("found", "topic").count().groupBy("found").agg(F.max("count").alias("m"), F.sum("count").alias("n")).agg(F.sum("m") / F.sum("n"))
    return best.first()[0]


def test_kmeans_and_density_find_the_blobs(blobs):
    vectors = blobs.withColumn("vector", array_to_vector("embedding"))
    reduced = tm.reduce_dims(vectors, tm.fit_reducer(vectors, k=2)).cache()
    found = tm.cluster_topics(reduced, tm.fit_clusters(reduced, ks=(2, 3, 5)))
    joined = blobs.join(found.withColumnRenamed("topic", "found"), "ticket_id")
    assert purity(joined) == 1.0 and joined.select("found").distinct().count() == 3
    assert joined.filter("found = 0").select("topic").distinct().first()[0] == 0  # the largest is number 0
    dense = tm.density_topics(reduced, 0.15)
    joined = blobs.join(dense.withColumnRenamed("topic", "found"), "ticket_id").filter("found >= 0")
    assert purity(joined) == 1.0 and joined.select("found").distinct().count() == 3 and joined.count() > 120


def test_prediction_and_probability(blobs, spark):
    centroids = tm.topic_centroids(blobs)
    texts = blobs.withColumn("text", F.lit("a long text")).unionByName(
        spark.createDataFrame([("short", 0, [1.0, 0.0, 0.0, 0.0], " x ")], "ticket_id string, topic int, embedding array<double>, text string")
    )
    keywords = spark.createDataFrame([(0, 1, "one"), (0, 2, "two")], "topic int, rank int, term string")
    got = {r["ticket_id"]: r for r in tm.predict_topics(texts, centroids, keywords).collect()}
    assert got["short"]["topic"] == -1 and got["short"]["keywords"] == [] and got["short"]["probability"] == 0.0
    assert got["0-0"]["topic"] == 0 and got["0-0"]["keywords"] == ["one", "two"] and got["1-0"]["keywords"] == []
    assert 1 / 3 < got["0-0"]["probability"] < 1
    own = tm.topic_probability(blobs, centroids, "topic").filter("ticket_id = '0-0'").first()["probability"]
    assert own == pytest.approx(got["0-0"]["probability"])
    near = tm.representative_docs(blobs, centroids, n=3)
    assert near.groupBy("topic").count().filter("count <> 3").count() == 0
    odd = spark.createDataFrame([("null", 0, None), ("zero", 1, [0.0] * 4), ("far", 9, [1.0, 0.0, 0.0, 0.0])], "ticket_id string, topic int, embedding array<double>")
    found = {r["ticket_id"]: (r["topic"], r["similarity"], r["probability"]) for r in tm.closest_topic(odd.drop("topic"), centroids).collect()}
    assert found["null"] == found["zero"] == (-1, 0.0, 0.0) and found["far"][0] == 0
    assert {r["probability"] for r in tm.topic_probability(odd, centroids, "topic").collect()} == {0.0}
    assert {(r["topic"], r["similarity"]) for r in tm.representative_docs(odd, centroids).collect()} == {(0, 0.0), (1, 0.0), (9, 0.0)}


def test_topics_take_each_text_apart_once_per_step(spark):
    """One pass over the texts to fit a model, one to assign: counted by a function that notes its calls."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        calls.add(1)
        return text

    rows = [(i, ("red apple green pear " if i % 2 else "fast train slow bus ") + "abcde"[i % 5] * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "ticket_id long, text string").withColumn("text", noted.asNondeterministic()("text"))
    model = tm.fit_topics(df, ks=(2,), n_components=2, dimensions=64)
    assert calls.value == 40
    tm.assign_topics(df, model).filter("topic >= 0").write.format("noop").mode("overwrite").save()
    assert calls.value == 80


def test_assign_topics_gives_short_texts_minus_one(spark):
    rows = [(str(i), "parcel courier delivery late" if i % 2 else "invoice refund charge card") for i in range(40)] + [("s", "ab"), ("n", None)]
    df = spark.createDataFrame(rows, "ticket_id string, text string")
    model = tm.fit_topics(df, ks=(2,), n_components=2, dimensions=64)
    got = {r["ticket_id"]: r["topic"] for r in tm.assign_topics(df, model).collect()}
    assert got["s"] == got["n"] == -1 and len(got) == 42
    assert len({got[str(i)] for i in range(0, 40, 2)}) == 1 and got["0"] != got["1"]


def test_rerank(spark):
    keywords = spark.createDataFrame([(0, 1, "a", 2.0), (0, 2, "b", 1.0), (0, 3, "c", 0.5)], "topic int, rank int, term string, weight double")
    words = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.1])], "term string, vector array<double>")
    topics = spark.createDataFrame([(0, [1.0, 0.0])], "topic int, vector array<double>")
    got = tp.rerank_keywords(keywords, words, topics).orderBy("rank").collect()
    assert [r["term"] for r in got] == ["b", "a", "c"]


def test_topic_words(spark):
    topics = spark.createDataFrame([(str(i), f"t{min(i, 7)}") for i in range(9)], "ticket_id string, topic_label string")
    texts = spark.createDataFrame([(str(i), "parcel parcel courier") for i in range(9)], "ticket_id string, text string")
    got = tp.topic_word_counts(topics, texts, n_topics=6, n_words=1).collect()
    assert len(got) == 6 and {r["word"] for r in got} == {"parcel"}
    assert {r["topic_label"]: r["count"] for r in got}["t7"] == 4
