"""SentencePiece encoding and decoding by streaming Viterbi.

The ids of a text are those of its segmentation into pieces with the largest sum of scores; of equal sums, the one
whose last piece, then last but one and so on, is the longest.  Each character that no piece of one character covers
may stand alone at the lowest score less ten, and is written as its UTF-8 bytes.  This is what the unigram algorithm
does; a model trained for pair merges gives its vocabulary and scores, and ids may differ from those of merging.

The search keeps a window of the longest piece only.  Paths that end in the window are followed back now and then; up
to the boundary where all of them meet, ids are final and leave the window, so a text of any length needs bounded
memory.  Spaces speed this up: where no piece has a space mark after another character, all paths meet before every
word, and where no longer piece has a line feed, at either side of it.  Words met before come from a bounded cache.

Spaces become marks and one mark is put in front; the mark itself, in a text, is read back as a space, and every other
text is read back as it was.

Defined results: null and empty texts have no ids and are read back as empty; repeated rows are encoded each; an empty
table gives no rows; columns of any name pass through, those named like outputs are replaced.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowed import map_arrow

MARK = "▁"
CACHE_WORDS, KEPT_WORDS = 300_000, 100_000
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file, and its encoder and decoder."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i)) for i in range(len(names))]
        self.scores = {p: (model.get_score(i), i) for i, p in enumerate(names) if plain[i]}
        self.longest = max(map(len, self.scores))
        self.root: list = [{}, None, 0]  # a tree of characters: followers, score and id of the piece that ends here
        for p, (score, i) in self.scores.items():
            node = self.root
            for c in p:
                node = node[0].setdefault(c, [{}, None, 0])
            node[1:] = score, i
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self.bytes = {i: int(names[i][3:5], 16) for i in range(len(names)) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.text_of = {i: names[i].replace(MARK, " ").encode() if plain[i] else b"" for i in range(len(names))}
        self.text_of |= {i: bytes([b]) for i, b in self.bytes.items()}
        self.text_of[self.unknown_id] = " ⁇ ".encode()
        longer = [p for p in self.scores if len(p) > 1]
        self.split_words = all(MARK not in p.lstrip(MARK) for p in longer)
        self.split_lines = all("\n" not in p for p in longer)
        self.cache: dict[str, bytes] = {}

    def stream(self, characters: Iterator[str]) -> Iterator[list[str]]:
        """Pieces of a stream of characters, as soon as they are final."""
        longest, scores = self.longest, self.scores
        text, first, done = "", 0, 0  # text[0] is character number first; all before done is final
        best, back = {0: 0.0}, {0: 0}  # by boundary: the best sum up to it, and where its last piece starts
        end = 0
        for c in characters:
            text += c
            end += 1
            total, start = None, 0
            for a in range(max(done, end - longest), end):  # from the longest piece on, so that it wins a tie
                found = scores.get(text[a - first :])
                if found is not None and (total is None or best[a] + found[0] > total):
                    total, start = best[a] + found[0], a
            if c not in scores and (total is None or best[end - 1] + self.unknown > total):
                total, start = best[end - 1] + self.unknown, end - 1
            best[end], back[end] = total, start
            if end - done > 4 * longest:
                alive = set(range(end - longest + 1, end + 1))
                while len(alive) > 1:  # the last one goes back until all meet
                    top = max(alive)
                    alive.remove(top)
                    alive.add(back[top])
                meet = alive.pop()
                if meet > done:
                    yield self._path(text, first, done, meet, back)
                    for b in range(done, meet):
                        del best[b], back[b]
                    text, first, done = text[meet - first :], meet, meet
        if end > done:
            yield self._path(text, first, done, end, back)

    @staticmethod
    def _path(text: str, first: int, start: int, end: int, back: dict[int, int]) -> list[str]:
        out = []
        while end > start:
            out.append(text[back[end] - first : end - first])
            end = back[end]
        return out[::-1]

    def word(self, word: str) -> array:
        """Ids of a short text, with all boundaries at once."""
        n, root = len(word), self.root
        best, back, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for a in range(n):
            base, node = best[a], root
            for e in range(a, n):
                node = node[0].get(word[e])
                if node is None:
                    break
                if node[1] is not None and base + node[1] > best[e + 1]:
                    best[e + 1], back[e + 1], ids[e + 1] = base + node[1], a, node[2]
            if word[a] not in self.scores and base + self.unknown > best[a + 1]:
                best[a + 1], back[a + 1], ids[a + 1] = base + self.unknown, a, -1
        out = []
        while n:
            out += [ids[n]] if ids[n] >= 0 else reversed(self._ids([word[n - 1]]))
            n = back[n]
        return array("I", reversed(out))

    def _ids(self, pieces: list[str]) -> array:
        out = array("I")
        for p in pieces:
            found = self.scores.get(p)
            if found is not None:
                out.append(found[1])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(self.unknown_id)
        return out

    def _learn(self, word: str) -> bytes:
        """Ids of a word with its mark, as little-endian unsigned 32-bit bytes."""
        if self.split_lines and "\n" in word and len(word) > 1:
            return b"".join(self._cached(x) for x in re.findall(r"\n|[^\n]+", word))
        if len(word) > 4 * self.longest:
            return b"".join(self._ids(p).tobytes() for p in self.stream(iter(word)))
        found = self.word(word).tobytes()
        if len(self.cache) >= CACHE_WORDS:  # those that came first stay: the common words are among them
            self.cache = dict(itertools.islice(self.cache.items(), KEPT_WORDS))
        self.cache[word] = found
        return found

    def _cached(self, word: str) -> bytes:
        found = self.cache.get(word)
        return self._learn(word) if found is None else found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        text = MARK + text.replace(" ", MARK)
        if not self.split_words:
            return b"".join(self._ids(p).tobytes() for p in self.stream(iter(text)))
        words = re.findall(f"{MARK}+[^{MARK}]*", text)
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._cached(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        text = b"".join(map(self.text_of.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(file: str | None = None) -> Pieces:
    """One encoder a worker process."""
    file = file or default_model()
    if file not in _LOADED:
        _LOADED[file] = Pieces(file)
    return _LOADED[file]


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of their texts: little-endian unsigned 32-bit numbers, as binary."""
    docs = docs.drop(out_col)
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model)
        for b in batches:
            ids = [p.encode(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=schema.names)

    return map_arrow(docs, run, schema)


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the texts of their ids (null: empty)."""
    rows = rows.drop(out_col)
    at, schema = rows.columns.index(ids_col), T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model)
        for b in batches:
            texts = [p.decode(i or b"") for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return map_arrow(rows, run, schema)
