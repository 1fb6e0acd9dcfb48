"""Exact byte-pair encoding with a SentencePiece model by backtracking, and decoding.

The usual encoder merges the best neighbouring pair again and again. Its result is the only sequence of pieces in which every two
neighbours are compatible, that is, merging the characters of both gives just these two. So the encoder walks through the text,
takes at each position the longest piece that an Aho-Corasick automaton found there, and checks it against the piece before
by merging the two anew (remembered per pair). If no piece fits, it takes the last one back and marks the position in a
bitfield as one from which the rest cannot be encoded; no position is tried twice.

Pieces hold the blank sign only at their start, so a text is cut before its blanks into words that are encoded apart and remembered
with their ids and their decoded text. A new word is cut where letters meet other characters, if no piece of the model holds both,
and these parts are remembered too. Runs of bytes never go beyond a word, so that the decoded words joined are the decoded ids.
Characters without a piece become the pieces of their bytes.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

_BLANK = "▁"
_MEMO_LIMIT = 300_000
_NONE = float("-inf")
_WORDS = re.compile(f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+")
_BYTE_RUNS = re.compile("[\udc00-\udcff]+")


class PieceEncoder:
    """Encodes and decodes with the pieces and scores of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(len(self.pieces)) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.end, self.unknown, self.special = model.eos_id(), model.unk_id(), special
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.bytes}
        self.plain = set(self.ids.values())
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        runs = {p for p in self.ids if set(p) == {_BLANK}}
        low = max((self.scores[p] for p in runs if len(p) > 1), default=None)
        for p in self.ids:
            if _BLANK in p[1:] and p not in runs:
                raise ValueError(f"piece {p!r} has a blank within")
            if low is not None and len(p) > 1 and p not in runs and self.scores[p] <= low:
                raise ValueError(f"piece {p!r} ranks below a run of blanks")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids), default=1)
        self.characters = {p for p in self.ids if len(p) == 1}
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cut = self._cuts()
        self.following = Following(self, _MEMO_LIMIT)
        self.first = Remembered(self._first, 1 << 20)  # one entry for each beginning of a piece
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}
        self.steps = functools.lru_cache(None)(self._steps)  # at most two entries for each piece
        self.blanks = functools.lru_cache(1 << 10)(self._blanks)
        self.memo, self.parts = Remembered(self._word, _MEMO_LIMIT), Remembered(self._part, _MEMO_LIMIT // 2)
        self.number = {p: str(i) for p, i in self.ids.items()}
        self.shown = {p: p.replace(_BLANK, " ") for p in self.ids}
        self.written = {i: self.pieces[i].replace(_BLANK, " ") for i in self.plain} | {i: "" for i in special}
        # Bytes are written as lone surrogates, which no piece holds, until their runs are decoded.
        self.written |= {i: chr(0xDC00 + b) for i, b in self.bytes.items()}
        self.run = functools.lru_cache(1 << 16)(_run)

    def _cuts(self) -> Callable[[str], list[str]]:
        """Cuts a word into runs of letters and of other characters, if no piece holds both."""
        signs = re.escape("".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
        letter, parts = re.compile(rf"[^\W\d_{signs}]"), re.compile(rf"{_BLANK}?[^\W\d_{signs}]+|{_BLANK}?[\W\d_{signs}]+")
        apart = all(bool(letter.match(a)) == bool(letter.match(b)) for a, b in self.neighbours if _BLANK not in (a, b))
        return parts.findall if apart else lambda text: [text]

    def merge(self, text: str) -> list[str]:
        """The model's own rule: join the best pair, the leftmost among equals, until none is a piece."""
        parts, score = list(text), self.scores.get
        ranks = [score(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) != _NONE:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = score(parts[at - 1] + parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = score(parts[at] + parts[at + 1], _NONE)
        return parts

    def _steps(self, piece: str, last: bool) -> list[tuple[float, str]] | None:
        """The merges that make a piece from its characters: score of each, and the part at its last (or first) place after it.
        None if the characters do not merge to the piece."""
        parts, score, out = list(piece), self.scores.get, []
        while len(parts) > 1:
            ranks = [score(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            best = max(ranks)
            if best == _NONE:
                return None
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[-1] if last else parts[0]))
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives just these two: their own merges, best first, until one across the border is
        better than the next of either (then not) or none is left."""
        own, other = self.steps(left, True) if left else [], self.steps(right, False)
        if own is None or other is None:
            return False
        if not left:
            return True
        i, j, a, b, score = 0, 0, left[-1], right[0], self.scores.get
        n, m = len(own), len(other)
        while True:
            x, y = own[i][0] if i < n else _NONE, other[j][0] if j < m else _NONE
            across = score(a + b, _NONE)
            if i < n and x >= across and x >= y:
                a = own[i][1]
                i += 1
            elif across >= y:
                return across == _NONE
            else:
                b = other[j][1]
                j += 1

    def _first(self, text: str) -> str:
        """The longest piece with which a beginning of pieces begins."""
        return next(text[:n] for n in range(len(text), 0, -1) if text[:n] in self.ids)

    def _blanks(self, n: int) -> list[str]:
        """A run of blanks: all its merges rank alike, so it grows from the left up to the longest piece."""
        longest = max((len(p) for p in self.ids if set(p) == {_BLANK}), default=1)
        whole, rest = divmod(n, longest)
        return [_BLANK * longest] * whole + self.merge(_BLANK * rest)

    def _known(self, text: str) -> list[str]:
        """Pieces of a text of known characters with at most one blank, at its start."""
        n, longest, reach, first, shorter, following = len(text), self.longest, self.automaton.longest_prefix, self.first, self.shorter, self.following
        failed, at, out = 0, 0, []
        fitting = following[""]  # for the longest piece ahead, the longest one that fits behind the last
        ahead = text[:longest]
        piece = fitting[first[ahead[: reach(ahead)]]]
        while True:
            while failed and piece is not None and failed >> (at + len(piece)) & 1:
                piece = fitting[shorter[piece]]
            if piece is None:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                fitting = following[out[-1] if out else ""]
                piece = fitting[shorter[last]]
                continue
            out.append(piece)
            at += len(piece)
            if at == n:
                return out
            fitting = following[piece]
            ahead = text[at : at + longest]
            piece = fitting[first[ahead[: reach(ahead)]]]

    def _apart(self, text: str) -> list[int]:
        """Ids of a text with characters that no piece holds. It is cut where no piece holds both characters, so that these stand alone."""
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            if b - a > 1 or text[a] in self.characters:
                out += [self.ids[p] for p in self._known(text[a:b])]
            else:
                out += [self.byte_ids.get(x, self.unknown) for x in text[a].encode()] if self.byte_ids else [self.unknown]
        return out

    def _written(self, ids: list[int]) -> tuple[str, str]:
        """Decimal ids, and their decoded text."""
        decoded = "".join([self.written[i] for i in ids])
        if not decoded.isascii():
            decoded = _BYTE_RUNS.sub(lambda m: self.run(m[0]), decoded)
        return " ".join(map(str, ids)), decoded

    def _part(self, text: str) -> tuple[str, str]:
        if not self.characters.issuperset(text):
            return self._written(self._apart(text))
        pieces = self._known(text)
        return " ".join([self.number[p] for p in pieces]), "".join([self.shown[p] for p in pieces])

    def _word(self, key: str) -> tuple[str, str]:
        """Ids and decoded text of a word that stands behind a blank; the text without that blank.

        Runs of blanks merge last, so all but the last blank stay out of the word."""
        body = key.lstrip(_BLANK)
        blanks = len(key) - len(body) + 1
        if not body:
            ids, decoded = self._written([self.ids[p] for p in self.blanks(blanks)])
        elif blanks == 1:
            parts = self.cut(_BLANK + body)
            if len(parts) == 1:
                ids, decoded = self._part(parts[0])
            else:
                head, tails = self.memo[parts[0][1:]], [self.parts[p] for p in parts[1:]]
                ids, decoded = " ".join([head[0], *[t[0] for t in tails]]), "".join([" ", head[1], *[t[1] for t in tails]])
        else:
            one = [int(i) for i in self.memo[body][0].split(" ")]
            alone = one[0] == self.ids.get(_BLANK)
            ids, decoded = self._written([self.ids[p] for p in self.blanks(blanks if alone else blanks - 1)] + one[alone:])
        decoded = decoded[1:]
        return ids, key if decoded == key else decoded

    def words(self, text: str | None) -> list[str]:
        """A text's words without the blank that stands before each; other blanks belong to the word behind them."""
        if not text:
            return []
        if "  " in text or _BLANK in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORDS.findall(_BLANK + text.replace(" ", _BLANK))]
        return text.split(" ")

    def encode(self, text: str | None) -> list[int]:
        """Ids as the library gives them, with an end id and no start id."""
        return [int(i) for w in self.words(text) for i in self.memo[w][0].split(" ")] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: blanks for blank signs, without the first one; bytes that are no UTF-8 become replacement signs."""
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(_BLANK, " ").removeprefix(" ")
        out: list[str] = []
        pending = bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(_lenient(bytes(pending)))
                pending.clear()
            if i is not None and i not in self.special:
                out.append(self.pieces[i].replace(_BLANK, " "))
        text = "".join(out)
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and first not in self.bytes and text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text, and the ids, from remembered words."""
        words = [*map(self.memo.__getitem__, self.words(text))]
        ids = " ".join([*[w[0] for w in words], str(self.end)])
        decoded = " ".join([w[1] for w in words])
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids


class Fitting(dict):
    """For a piece, itself or the longest piece it begins with that fits behind the left one; None if there is none."""

    def __init__(self, owner: Following, left: str):
        self.owner, self.left = owner, left
        self[None] = None

    def __missing__(self, piece: str) -> str | None:
        self.owner.size += 1
        tool = self.owner.tool
        value = self[piece] = piece if tool.fits(self.left, piece) else self[tool.shorter[piece]]
        return value


class Following(dict):
    """A ``Fitting`` for each left piece; all are forgotten when they hold too many answers."""

    def __init__(self, tool: PieceEncoder, limit: int):
        self.tool, self.limit, self.size = tool, limit, 0

    def __missing__(self, left: str) -> Fitting:
        if self.size >= self.limit:
            self.size = 0
            self.clear()
        value = self[left] = Fitting(self, left)
        return value


class Remembered(dict):
    """Results by key in two generations: when the younger is full, the elder is forgotten but for what is used again."""

    def __init__(self, make: Callable[[str], object], limit: int):
        self.make, self.limit, self.elder = make, limit, {}

    def __missing__(self, key: str) -> object:
        if len(self) >= self.limit:
            self.elder = dict(self)
            self.clear()
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _run(marks: str) -> str:
    return _lenient(bytes(ord(c) - 0xDC00 for c in marks))


def _lenient(data: bytes) -> str:
    """UTF-8, one replacement sign for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each model and Python worker, so that remembered words serve all its tasks."""
    return PieceEncoder(path)


def encode_documents(
    documents: DataFrame, model: Callable[[], str] | str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, ids as a decimal string.

    ``model`` is the path of a SentencePiece BPE model or a function that gives it, called on the executors. Whole texts are
    encoded with an end id only; a null or empty text has the end id alone and decodes to an empty text. Rows are
    independent: repeated rows get equal answers, other columns are ignored, an empty table gives no rows. Memory is bounded by
    one Arrow batch and the remembered words.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model() if callable(model) else model)
        for batch in batches:
            rows = [tool.digest(t.as_py()) if with_ids else tool.digest(t.as_py())[:3] for t in batch.column("text")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(3 + with_ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    narrow = documents.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids string" * with_ids
    return narrow.mapInArrow(run, schema)
