"""Token windows for the model score, against a plain loop."""

import pytest

from ticketlens.operators import model as md


def loader():
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError
            return [("Negative" if "bad" in t else "Positive", 0.5 + len(t.split()) % 7 / 14) for t in texts]

        return predict

    return load


def plain(text, size, overlap):
    words, at, sums, total = (text or "").split(" "), 0, {}, 0
    words = [w for w in words if w]
    while True:
        part = words[at : at + size]
        n = max(len(part), 1)
        if "boom" not in part:
            label, score = loader()()([" ".join(part)])[0]
            sums[label.lower()] = sums.get(label.lower(), 0) + n * score
            total += n
        if at + size >= len(words):
            break
        at += size - overlap
    if not sums:
        return "neutral", 0.0
    label = min(sums, key=lambda k: (-round(sums[k], 6), k))
    return label, sums[label] / total


def test_whole_texts_count(spark):
    texts = [None, "", "   ", "bad", "fine " * 10, "fine " * 11, "fine " * 200 + "bad " * 900, "bad " * 900 + "fine " * 20, "x " * 17, "boom", "boom " + "ok " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, clean string")
    score = md.windowed_model_scores(loader(), md.token_spans("[^ ]+"), size=10, overlap=3, batch_tokens=1)
    got = {r["i"]: (r["model_label"], round(r["model_score"], 9)) for r in score(df).collect()}
    assert got == {i: (label, round(s, 9)) for i, (label, s) in ((i, plain(t, 10, 3)) for i, t in enumerate(texts))}
    assert got[6][0] == "negative" and got[9] == ("neutral", 0.0)
    assert score(df.limit(0)).collect() == []


def test_one_window_keeps_the_score_and_batches_are_bounded(spark):
    def note():
        def predict(texts):
            assert len(texts) * max(len(t.split()) for t in texts) <= 64 * 512
            return [("NEGATIVE", 0.9)] * len(texts)

        return predict

    df = spark.createDataFrame([("bad day",), ("very bad day " * 50,)], "clean string")
    assert {(r.model_label, round(r.model_score, 9)) for r in md.windowed_model_scores(note)(df).collect()} == {("negative", 0.9)}
    assert md.token_windows([(i, i + 1) for i in range(25)], 25, 10, 4) == [(0, 10, 10), (6, 16, 10), (12, 22, 10), (18, 25, 7)]
    assert md.token_windows([], 3, 10, 4) == [(0, 3, 1)]
    with pytest.raises(ValueError):
        md.windowed_model_scores(note, size=4, overlap=4)
