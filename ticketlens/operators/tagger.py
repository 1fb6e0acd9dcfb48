"""A trained tagger for names that no list holds: a structured perceptron with Viterbi decoding.

The listed names label a bounded sample of tickets. Every token gets a label of the BIO scheme (first token of a name, inside, outside); the
score of a sequence is the sum of token scores, from the words around each place, and of transition scores. Training decodes each sampled
text and moves the weights towards the right sequence where the best one is wrong; the weights of all steps are averaged. A share of
the sample's tokens hides its own spelling, so that names are recognised by their shape and by what stands beside them.

All features belong to one word at one distance, so a word's contribution is a vector that is made once and looked up afterwards.
Texts of a batch are decoded together, sorted by length, in blocks of a bounded number of tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ticketlens.operators.entities import MIN_TEXT_LENGTH, gazetteer_entities
from ticketlens.functions import text as tx
from ticketlens.session import materialise

TOKEN = re.compile(r"\w+|[^\w\s]")
_DISTANCES = (-2, -1, 0, 1, 2)
_FAR = -1e9
_MEMO_LIMIT = 100_000
_BLOCK_TOKENS = 1 << 16


@dataclass(frozen=True)
class TaggerPlan:
    """``sample``: expected tickets that the driver gets, with at most ``longest`` tokens of each; these bound what is learnt from. Texts to be
    tagged have no bound. ``hide``: share of tokens whose own spelling is hidden in training."""

    sample: int = 3000
    longest: int = 400
    epochs: int = 6
    hide: float = 0.7
    seed: int = 13


def shape(word: str) -> str:
    """Kinds of a word's characters without repeats, at most six: ``X`` capital, ``x`` other letter, ``9`` digit, else the sign itself."""
    out = ""
    for c in word[:40]:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(kind):
            out += kind
    return out[:6]


def word_features(word: str, distance: int, hidden: bool = False) -> list[str]:
    """Names of the features that a word gives to the place at a distance from it. The own spelling of a hidden word is left out."""
    low, at = word.lower(), f"{distance}:"
    if distance == 0:
        out = [at + "shape=" + shape(word), at + "digits=" + str(sum(c.isdigit() for c in word) and len(word)), at + "title=" + str(word.istitle())]
        return out if hidden else [*out, at + "word=" + low, at + "end=" + low[-3:], at + "begin=" + low[:3]]
    return [at + "shape=" + shape(word), at + "word=" + low] if abs(distance) == 1 else [at + "word=" + low]


_EDGE = {d: [f"{d}:edge"] for d in _DISTANCES}


def bio_labels(types: Sequence[str]) -> list[str]:
    return ["O", *[f"{p}-{t}" for t in types for p in "BI"]]


def allowed(labels: Sequence[str]) -> np.ndarray:
    """0 where a label may stand behind another (the last row: at the start), else a very low score."""
    n = len(labels)
    out = np.zeros((n + 1, n))
    for j, label in enumerate(labels):
        if label.startswith("I-"):
            out[:, j] = _FAR
            for i, before in enumerate(labels):
                if before[2:] == label[2:] and before != "O":
                    out[i, j] = 0
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label sequences of texts (text, place, label) padded to one length. ``moves`` has a row for the label before, the last one
    for the start. Among equal scores the smaller label wins at each step back."""
    n, longest, _ = scores.shape
    best = scores[:, 0] + moves[-1]
    back = np.zeros(scores.shape, np.int16)
    ends = np.zeros((n, scores.shape[2]))
    ends[lengths == 1] = best[lengths == 1]
    for i in range(1, longest):
        ways = best[:, :, None] + moves[None, :-1]
        back[:, i] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[:, i]
        done = lengths == i + 1
        ends[done] = best[done]
    out = np.zeros((n, longest), np.int16)
    now = ends.argmax(axis=1)
    rows = np.arange(n)
    for i in range(longest - 1, -1, -1):
        inside = i < lengths
        out[inside, i] = now[inside]
        now = np.where(inside, back[rows, i, now], now)
    return out


class Tagger:
    """Labels, feature weights (feature to a vector over labels) and transition weights."""

    def __init__(self, labels: list[str], weights: dict[str, np.ndarray], moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves
        self.memo: dict[tuple[str, int], np.ndarray] = {}
        self.limits = allowed(labels)

    def _vector(self, word: str | None, distance: int) -> np.ndarray:
        found = self.memo.get((word, distance))
        if found is None:
            if len(self.memo) > _MEMO_LIMIT:
                self.memo.clear()
            names = _EDGE[distance] if word is None else word_features(word, distance)
            found = self.memo[(word, distance)] = np.sum([self.weights[f] for f in names if f in self.weights], axis=0) + np.zeros(len(self.labels))
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores (place, label) of a text's tokens."""
        out = np.zeros((len(words), len(self.labels)))
        for d in _DISTANCES:
            for i in range(len(words)):
                out[i] += self._vector(words[i + d] if 0 <= i + d < len(words) else None, d)
        return out

    def tag(self, texts: list[list[str]]) -> list[list[str]]:
        """A label for every token of every text."""
        out: list[list[str]] = [[] for _ in texts]
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(texts[order[to]]) <= _BLOCK_TOKENS:
                to += 1
            block = order[at:to]
            lengths = np.array([len(texts[i]) for i in block])
            scores = np.zeros((len(block), lengths[-1], len(self.labels)))
            for row, i in enumerate(block):
                scores[row, : len(texts[i])] = self.scores(texts[i])
            for row, i in zip(viterbi(scores, self.moves + self.limits, lengths), block):
                out[i] = [self.labels[k] for k in row[: len(texts[i])]]
            at = to
        return out


def spans(text: str, labels: list[str], tokens: list[re.Match]) -> list[tuple[str, str, int, int]]:
    """(text, type, start, end) of the names that the labels mark."""
    out: list[list] = []
    for token, label in zip(tokens, labels):
        if label.startswith("B-"):
            out.append([label[2:], token.start(), token.end()])
        elif label.startswith("I-"):
            out[-1][2] = token.end()
    return [(text[a:b], kind, a, b) for kind, a, b in out]


def _labelled_words(text: str, found: Iterable[tuple[str, int, int]], longest: int) -> tuple[list[str], list[str]]:
    tokens = [m for m in TOKEN.finditer(text)][:longest]
    labels = ["O"] * len(tokens)
    end = -1
    for kind, start, stop in sorted(found, key=lambda f: (f[1], -f[2], f[0])):
        inside = [i for i, m in enumerate(tokens) if start <= m.start() and m.end() <= stop]
        if start < end or not inside:
            continue
        end = stop
        for n, i in enumerate(inside):
            labels[i] = ("I-" if n else "B-") + kind
    return [m[0] for m in tokens], labels


def fit(sample: list[tuple[list[str], list[str]]], labels: list[str], plan: TaggerPlan = TaggerPlan()) -> Tagger:
    """An averaged structured perceptron over (words, labels) of sampled texts, in a fixed shuffled order."""
    index: dict[str, int] = {}
    number = {label: i for i, label in enumerate(labels)}
    rows = []
    for k, (words, gold) in enumerate(sample):
        if not words:
            continue
        hidden = [zlib.crc32(f"{plan.seed}:{k}:{i}".encode()) % 1000 < plan.hide * 1000 for i in range(len(words))]
        features = [
            [index.setdefault(f, len(index)) for d in _DISTANCES
             for f in (word_features(words[i + d], d, d == 0 and hidden[i]) if 0 <= i + d < len(words) else _EDGE[d])]
            for i in range(len(words))
        ]
        rows.append((features, np.array([number[g] for g in gold])))
    n = len(labels)
    weights, spent = np.zeros((len(index) + 1, n)), np.zeros((len(index) + 1, n))
    moves, moves_spent, limits = np.zeros((n + 1, n)), np.zeros((n + 1, n)), allowed(labels)
    packed = []
    for features, gold in rows:
        at = np.full((len(features), max(map(len, features))), len(index))
        for i, f in enumerate(features):
            at[i, : len(f)] = f
        packed.append((at, gold))
    rng, step = np.random.default_rng(plan.seed), 1
    for _ in range(plan.epochs):
        for k in rng.permutation(len(packed)):
            at, gold = packed[k]
            got = viterbi(weights[at].sum(axis=1)[None], moves + limits, np.array([len(gold)]))[0]
            if not np.array_equal(got, gold):
                for path, sign in ((gold, 1.0), (got, -1.0)):
                    before = np.concatenate(([n], path[:-1]))
                    for total, unit in ((weights, sign), (spent, sign * step)):
                        np.add.at(total, (at, path[:, None]), unit)
                    for total, unit in ((moves, sign), (moves_spent, sign * step)):
                        np.add.at(total, (before, path), unit)
                weights[-1] = spent[-1] = 0
            step += 1
    mean, mean_moves = weights - spent / step, moves - moves_spent / step
    return Tagger(labels, {f: mean[i] for f, i in index.items() if np.any(mean[i])}, mean_moves)


def train_tagger(
    tickets: DataFrame, names: DataFrame, plan: TaggerPlan = TaggerPlan(), id_col: str = "ticket_id", text_col: str = "text"
) -> Tagger:
    """The tagger learnt from a sample of ``tickets`` in which ``names`` (name, label) were found.

    The sample is fixed by a hash of the texts. Null and blank texts are not learnt from; without tickets or names the tagger finds nothing.
    """
    types = sorted(r.label for r in names.select("label").distinct().collect())
    texts = tickets.select(F.col(id_col).cast(StringType()).alias("ticket_id"), tx.strip(F.col(text_col)).alias("text")).filter(F.length("text") >= MIN_TEXT_LENGTH)
    share = min(1.0, plan.sample / max(1, texts.count()))
    lucky = F.pmod(F.xxhash64("text", F.lit(plan.seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = materialise(texts.filter(lucky), "tagger-sample")
    found = gazetteer_entities(sample, names).groupBy("ticket_id").agg(F.collect_list(F.struct("entity_type", "start", "end")).alias("found"))
    rows = sample.join(found, "ticket_id", "left").select("text", "found").collect()
    labelled = [_labelled_words(r.text, [tuple(f) for f in r.found or ()], plan.longest) for r in sorted(rows, key=lambda r: r.text)]
    return fit(labelled, bio_labels(types), plan)


def tagged_entities(df: DataFrame, tagger: Tagger, id_col: str = "ticket_id", text_col: str = "text") -> DataFrame:
    """Mentions that the tagger finds: (id, entity, entity_type, start, end), places in the stripped text as in the other extractors.

    Null, empty and one-character texts have none; repeated rows get equal mentions; an empty table gives no rows. Whole texts are tagged; a
    task holds one Arrow batch and one block of tokens.
    """
    labels, weights, moves = tagger.labels, tagger.weights, tagger.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(labels, weights, moves)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [list(TOKEN.finditer(t)) for t in texts]
            marked = own.tag([[m[0] for m in row] for row in tokens])
            found = [spans(t, row, places) for t, row, places in zip(texts, marked, tokens)]
            source = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            flat = [s for f in found for s in f]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            columns = [pa.array([s[k] for s in flat], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(source, pa.int64())), *columns], ["id", "entity", "entity_type", "start", "end"])

    readable = df.select(F.col(id_col).alias("id"), tx.strip(F.col(text_col)).alias("text")).filter(F.length("text") >= MIN_TEXT_LENGTH)
    kind = readable.schema["id"].dataType.simpleString()
    return readable.mapInArrow(run, f"id {kind}, entity string, entity_type string, start int, end int").withColumnRenamed("id", id_col)
