"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter's largest response in a window is kept, and a softmax
over these gives the languages' probabilities. A text is cut into windows of fixed length, all of which are scored in
batches; the text's probabilities are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.shingles import text_bytes

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class NetPlan:
    """``window``: bytes of a window; padding is byte 0. ``per_language``: expected texts of the training sample for each language, of
    which at most ``windows`` windows of each are learnt. These two bound what the driver gets."""

    window: int = 256
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    per_language: int = 400
    windows: int = 4
    epochs: int = 8
    rate: float = 0.01
    seed: int = 7


class ByteNet:
    """Parameters of the network. All filters are stored at the largest width; a narrower one is zero beyond its own."""

    def __init__(self, plan: NetPlan, languages: list[str]):
        self.plan, self.languages = plan, languages
        rng = np.random.default_rng(plan.seed)
        wide, n_filters = max(plan.widths), plan.filters * len(plan.widths)
        self.mask = np.zeros((wide, plan.embed, n_filters), np.float32)
        for i, width in enumerate(plan.widths):
            self.mask[:width, :, i * plan.filters : (i + 1) * plan.filters] = 1
        self.mask = self.mask.reshape(wide * plan.embed, n_filters)

        def random(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.values = {
            "embed": random(256, plan.embed, scale=0.5), "filters": random(wide * plan.embed, n_filters, scale=0.3) * self.mask,
            "bias": np.zeros(n_filters, np.float32), "out": random(n_filters, len(languages), scale=0.1),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.values["embed"][0] = 0

    def _responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plan, wide = self.plan, max(self.plan.widths)
        n, length = windows.shape
        e = self.values["embed"][windows]
        places = length - wide + 1
        columns = np.empty((n, places, wide, plan.embed), np.float32)
        for k in range(wide):
            columns[:, :, k] = e[:, k : k + places]
        columns = columns.reshape(n * places, wide * plan.embed)
        return columns, (columns @ self.values["filters"]).reshape(n, places, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Per window (rows of bytes) the probability of each language."""
        _, responses = self._responses(windows)
        return self._softmax(np.maximum(responses.max(axis=1) + self.values["bias"], 0))

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        scores = pooled @ self.values["out"] + self.values["out_bias"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        v, wide = self.values, max(self.plan.widths)
        columns, responses = self._responses(windows)
        n, places, n_filters = responses.shape
        best = responses.argmax(axis=1)
        top = np.take_along_axis(responses, best[:, None], axis=1)[:, 0] + v["bias"]
        pooled = np.maximum(top, 0)
        error = self._softmax(pooled)
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ v["out"].T) * (top > 0)
        rows = (np.arange(n)[:, None] * places + best).ravel()  # the column that won, for each window and filter
        filters = (columns[rows].reshape(n, n_filters, -1) * back[:, :, None]).sum(axis=0).T * self.mask
        to_columns = back[:, :, None] * v["filters"].T[None]
        embed = np.zeros_like(v["embed"])
        at = (best[:, :, None] + np.arange(wide)).reshape(n, -1)
        np.add.at(embed, np.take_along_axis(windows, at, axis=1).ravel(), to_columns.reshape(-1, self.plan.embed))
        embed[0] = 0
        return {"embed": embed, "filters": filters, "bias": back.sum(axis=0), "out": pooled.T @ error, "out_bias": error.sum(axis=0)}

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """Adam over shuffled batches of 64 windows."""
        rng = np.random.default_rng(self.plan.seed)
        first = {k: np.zeros_like(x) for k, x in self.values.items()}
        second = {k: np.zeros_like(x) for k, x in self.values.items()}
        step = 0
        for _ in range(self.plan.epochs):
            order = rng.permutation(len(labels))
            for start in range(0, len(order), 64):
                part = order[start : start + 64]
                step += 1
                for k, g in self.gradients(windows[part], labels[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.values[k] -= (self.plan.rate * move).astype(np.float32)
        return self


def cut(offsets: np.ndarray, data: np.ndarray, window: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows start, how long they are, and the text of each; ``most`` spreads that many over a text (for learning)."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // window))
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if most is not None:
        taken = (number * most) % np.maximum(counts, most)[text] < most
        text, number = text[taken], number[taken]
    start = offsets[text] + number * window
    return start, np.minimum(window, offsets[text + 1] - start), text


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    place = np.arange(window)
    at = np.minimum(start[:, None] + place, max(len(data) - 1, 0))
    bytes_ = _FOLD[data[at]] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(place < size[:, None], bytes_, 0).astype(np.uint8)


def train(labelled: DataFrame, plan: NetPlan = NetPlan(), text: str = "text", lang: str = "lang") -> ByteNet | None:
    """The network learnt from a sample of the rows with a text and a language, ``plan.per_language`` texts expected of each;
    None if there is no such row. The sample is fixed by a hash of the texts. Only the sample's windows reach the driver."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, plan.per_language / n))) for k, n in counts.items()])
    lucky = F.pmod(F.xxhash64("text", F.lit(plan.seed)), F.lit(1_000_000)) < share * 1_000_000

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            start, size, of = cut(offsets, data, plan.window, plan.windows)
            pieces = [x.tobytes() for x in gather(data, start, size, plan.window)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(of)), pa.array(pieces, pa.binary())], ["lang", "piece"])

    got = sorted((r.lang, bytes(r.piece)) for r in rows.filter(lucky).mapInArrow(windows, "lang string, piece binary").collect())
    languages = sorted(counts)
    if not got:
        return ByteNet(plan, languages)
    labels = np.array([languages.index(k) for k, _ in got])
    return ByteNet(plan, languages).fit(np.frombuffer(b"".join([p for _, p in got]), np.uint8).reshape(-1, plan.window), labels)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(documents: DataFrame, net: ByteNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, lang_pred, score; other columns are ignored.

    A null text, or one without a letter (Unicode), is ``und`` with score 0; so is every text if nothing was learnt. All windows
    of a text count. Equal texts get equal answers. An empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            known = np.array([_has_letter(t.as_py()) for t in texts], bool)
            languages, scores = ["und"] * len(texts), np.zeros(len(texts))
            if net is not None and known.any():
                offsets, data = text_bytes(texts)
                start, size, of = cut(offsets, data, net.plan.window)
                total = np.zeros((len(texts), len(net.languages)))
                for i in range(0, len(start), 128):
                    p = net.probabilities(gather(data, start[i : i + 128], size[i : i + 128], net.plan.window))
                    np.add.at(total, of[i : i + 128], p * size[i : i + 128, None])
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
                best = total.argmax(axis=1)
                languages = [net.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
                scores = np.where(known, np.clip(total.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
