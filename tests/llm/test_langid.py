import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm.langid import ByteNet, NetPlan, cut, fold, gather, identify, train
from ticketlens.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, lang_pred string, score string"


def test_gradients_by_differences():
    plan = NetPlan(window=12, embed=3, filters=2)
    net, rng = ByteNet(plan, ["a", "b", "c"]), np.random.default_rng(1)
    net.values = {k: v.astype(np.float64) for k, v in net.values.items()}
    windows, labels = rng.integers(1, 20, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    want = net.gradients(windows, labels)

    def loss():
        _, r = net._responses(windows)
        return -np.log(net._softmax(np.maximum(r.max(axis=1) + net.values["bias"], 0))[np.arange(5), labels]).mean()

    for name, value in net.values.items():
        for at in list(np.ndindex(value.shape))[: 60]:
            if name == "filters" and not net.mask[at] or name == "embed" and at[0] == 0:
                continue
            old = value[at]
            value[at] = old + 1e-3
            up = loss()
            value[at] = old - 1e-3
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-3 - want[name][at]) < 2e-2, (name, at)


def test_windows_cover_whole_texts():
    texts = [b"", b"x" * 256, b"y" * 257, b"Z"]
    offsets, data = np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
    start, size, of = cut(offsets, data, 256)
    assert list(of) == [0, 1, 2, 2, 3] and list(size) == [0, 256, 256, 1, 1]
    got = gather(data, start, size, 256)
    assert got[4, 0] == ord("z") and got[0].sum() == 0 and (got[2] == ord("y")).all()
    assert len(cut(np.array([0, 2560]), data, 256, 4)[0]) == 4


def test_held_out_accuracy(spark, folder):
    larger = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, larger).join(docs, "doc_id")
    rows = got.withColumn("f", fold(F.col("doc_id"), 4)).collect()
    assert len(rows) == 1000 and all(r.held_out == (r.f == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_odd_rows(spark):
    english, german = "the old house and the river were there " * 4, "das schöne Haus und der Fluß waren über Nacht " * 4
    rows = [(i, english + str(i), "en", "", "") for i in range(30)] + [(100 + i, german + str(i), "de", "", "") for i in range(30)]
    rows += [(1, None, "en", None, None), (2, "", "de", None, None), (3, "12 34 ...", None, None, None), (None, english * 900, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = train(docs, NetPlan(epochs=30))
    got = identify(docs, net).collect()
    assert len(got) == len(rows)
    by = [(r.doc_id, r.lang_pred, r.score) for r in got]
    assert (1, "und", 0.0) in by and (2, "und", 0.0) in by and (3, "und", 0.0) in by
    assert next(r for r in got if r.doc_id is None).lang_pred == "en"
    assert all(r.lang_pred == "de" for r in got if r.doc_id and r.doc_id >= 100)
    none = spark.createDataFrame([], SCHEMA)
    assert train(none) is None and identify(none, net).collect() == []
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
