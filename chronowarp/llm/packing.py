"""Best-fit packing by bin completion: whole documents in as few token sequences as can be found.

Only documents longer than a sequence are cut.  What decides a packing is how many pieces there are of each length,
so the search runs on that histogram, whose size is the sequence length and does not grow with the corpus:

* best-fit decreasing gives the first incumbent;
* branch and bound takes the largest piece left, enumerates the undominated fillings of the room beside it, least
  waste first, applies one as often as the counts allow, and prunes by the waste that a better packing may have;
* it stops at the lower bound, or after ``nodes`` nodes with the best packing so far (a search limit, not a data cap).

The result is a list of patterns with multiplicities.  A piece finds its place from its rank among the pieces of its
length; ranks come from counts per input partition, so no length, however common, is gathered in one task.

Defined results: null or empty text gives one piece of the end id alone; repeated rows are packed each; an empty
table gives no rows; columns other than the id and text columns are not read.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .arrowed import map_arrow
from . import arrowed, scratch

CAPACITY = 2048
END_ID = 0
CACHE_WORDS, KEPT_WORDS, TOGETHER = 800_000, 500_000, 64
_PART = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|(?:[^\s\w]|_)+|\w")
#: Where a piece was made: input partition, and rank there among pieces of its length.
PLACES = ("__part", "__rank")
Pattern = tuple[int, tuple[int, ...]]


class _WordIds(dict):
    """Lower-case word of a text, or part of one, to its ids as little-endian unsigned 32-bit bytes, up to
    ``CACHE_WORDS``; then the ``KEPT_WORDS`` that came first stay, which the common ones are among.

    The tokenizer composes characters, lower-cases, drops white space and merges within runs of letters, single digits,
    runs of other characters and a few endings after an apostrophe, so the ids of a text are those of its words' parts
    in turn.  Parts not met before are merged together, and told apart by their last token.  Texts in which a step could
    depend on its surroundings go through the tokenizer whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.merges, self.byte_merges = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        # added tokens, separators that only one side takes for white space, a letter whose lower case depends on the next
        self.whole = re.compile("|".join(map(re.escape, sorted(added | {"\x1c", "\x1d", "\x1e", "\x1f", "\u03a3"}))))

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self) + 2 * len(words) > CACHE_WORDS:
            first = list(itertools.islice(self.items(), KEPT_WORDS))
            self.clear()
            self.update(first)
        split = [(w, (w,) if w.isalpha() else tuple(_PART.findall(w))) for w in words]
        plain, wide, other = [], [], []
        for p in {p for _, parts in split for p in parts if p not in self}:
            if p.isalpha() or len(p) == 1 or not p[0].isalnum():
                (plain if p.isascii() and p.isprintable() else wide).append(p)  # bytes stand for themselves, or not
            else:
                other.append(p)
        for some, merges in ((plain, self.merges), (wide, self.byte_merges)):
            if not some:
                continue
            ids = np.array(merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) == len(some):
                raw, at = ids.tobytes(), 0
                for p, end in zip(some, ends.tolist(), strict=True):
                    self[p] = raw[at:end]
                    at = end
            else:
                other += some
        self.update((p, self.encode(p)) for p in other)
        for w, parts in split:
            self[w] = self[parts[0]] if len(parts) == 1 else b"".join([self[p] for p in parts])

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list = []
        fresh: set[str] = set()
        for text in texts:
            if self.whole.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
                out.append(self.encode(text))
                continue
            words = text.lower().split()
            found = list(map(self.get, words))
            late = [i for i, f in enumerate(found) if f is None] if None in found else []
            fresh.update([words[i] for i in late])
            out.append((words, found, late))
        if fresh:
            self.learn(list(fresh))
        for n, item in enumerate(out):
            if isinstance(item, tuple):
                words, found, late = item
                for i in late:
                    found[i] = self[words[i]]
                out[n] = b"".join(found)
        return out


def _word_ids(file: str) -> _WordIds:
    """One cache a worker process, kept from task to task while they pack."""
    return arrowed.held(f"words of {file}", lambda: _WordIds(file))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids (little-endian unsigned 32-bit) and ``PLACES``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField(PLACES[0], T.IntegerType()),
            T.StructField(PLACES[1], T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = _word_ids(tokenizer or default_tokenizer()), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end, step = array("I", [END_ID]).tobytes(), capacity * 4
        rows: list[tuple] = []

        def batch(doc_ids: pa.Array) -> pa.RecordBatch:
            row, piece, start, length, ids, rank = zip(*rows, strict=True)
            rows.clear()
            columns = [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array(ids, pa.binary()), pa.array([part] * len(rank), pa.int32()), pa.array(rank, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            held = 0
            texts = b.column(1).fill_null("")
            coded = (x for at in range(0, len(texts), TOGETHER) for x in known.texts(texts[at : at + TOGETHER].to_pylist()))
            for i, ids in enumerate(coded):
                ids += end
                for k in range(0, len(ids), step):
                    one = ids[k : k + step]
                    n = len(one) // 4
                    rows.append((i, k // step, k // 4, n, one, seen[n]))
                    seen[n] += 1
                held += len(ids)
                if held > 4 << 20:
                    yield batch(b.column(0))
                    held = 0
            if rows:
                yield batch(b.column(0))

    return map_arrow(docs, run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram of lengths."""
    room: dict[int, list[list]] = defaultdict(list)  # free room: [bins, pattern]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in range(length, capacity):
            if not left:
                break
            groups, room[free] = room.pop(free, []), []
            each = free // length
            for n, pattern in groups:
                full = min(n, left // each)
                left -= full * each
                some = left if full < n else 0
                left -= some
                for k, items in ((full, each), (1 if some else 0, some), (n - full - (1 if some else 0), 0)):
                    if k:
                        room[free - items * length].append([k, pattern + (length,) * items])
        each = capacity // length
        if left // each:
            room[capacity - each * length].append([left // each, (length,) * each])
        if left % each:
            room[capacity - (left % each) * length].append([1, (length,) * (left % each)])
    return [(n, pattern) for groups in room.values() for n, pattern in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by what large pieces leave unusable for those above a threshold."""
    total = sum(n * x for x, n in counts.items())
    best = -(-total // capacity)
    for t in range(1, capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - t)
        half = [(x, n) for x, n in counts.items() if capacity / 2 < x <= capacity - t]
        small = sum(n * x for x, n in counts.items() if t <= x <= capacity / 2)
        over = small - sum(n * (capacity - x) for x, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-over // capacity)))
    return best


def fillings(counts: list[int], largest: int, room: int, keep: int = 4, nodes: int = 300) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` from the pieces left, (waste, lengths) by waste: maximal ones in which no
    piece can give way to a larger one that is left."""
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = nodes

    def down(x: int) -> int:
        while x > 0 and not counts[x]:
            x -= 1
        return x

    def extend(most: int, free: int, chosen: tuple[int, ...]) -> None:
        nonlocal budget
        x = down(min(most, free))
        if not x:
            if not any(counts[y] for c in set(chosen) for y in range(c + 1, min(c + free, largest) + 1)):
                found.append((free, chosen))
            return
        while x and budget > 0 and not (found and found[-1][0] == 0 and len(found) >= keep):
            budget -= 1
            counts[x] -= 1
            if x == free:
                found.append((0, (*chosen, x)))
            else:
                extend(x, free - x, (*chosen, x))
            counts[x] += 1
            if x == free:  # fills the room alone: every other filling of it is dominated
                return
            x = down(x - 1)

    extend(largest, room, ())
    return sorted(set(found), key=lambda f: (f[0], len(f[1])))[:keep] or [(room, ())]


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 20_000) -> list[Pattern]:
    """Patterns (multiplicity, lengths) that hold every piece once, in as few bins as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    if not counts:
        return []
    total, bound = sum(n * x for x, n in counts.items()), lower_bound(counts, capacity)
    bins = sum(n for n, _ in best)
    state = [counts.get(x, 0) for x in range(capacity + 1)]
    # a frame: counts, largest length that may be left, waste, bins, patterns as a linked list, fillings still to try
    stack: list[list] = [[state, capacity, 0, 0, None, None]]
    while stack and bins > bound and nodes > 0:
        frame = stack[-1]
        left, top, waste, used, chain, todo = frame
        if todo is None:
            nodes -= 1
            while top and not left[top]:
                top -= 1
            if not top:
                if used < bins:
                    bins, best = used, []
                    while chain:
                        pattern, chain = chain
                        best.append(pattern)
                stack.pop()
                continue
            left[top] -= 1
            frame[5] = todo = fillings(left, top, capacity - top)[::-1]
            left[top] += 1
            frame[1] = top
        if not todo:
            stack.pop()
            continue
        free, chosen = todo.pop()
        pattern = (top, *chosen)
        use: dict[int, int] = defaultdict(int)
        for x in pattern:
            use[x] += 1
        times = min(left[x] // n for x, n in use.items())
        if waste + times * free > (bins - 1) * capacity - total:
            if not free or times == 1 or waste + free > (bins - 1) * capacity - total:
                continue
            times = ((bins - 1) * capacity - total - waste) // free
        after = left.copy()
        for x, n in use.items():
            after[x] -= n * times
        stack.append([after, top, waste + times * free, used + times, ((times, pattern), chain), None])
    return best


class Placement:
    """Where the r-th piece of a length goes, for arrays of lengths and ranks."""

    def __init__(self, patterns: list[Pattern]):
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        base = 0
        for times, lengths in patterns:
            at = 0
            for x in lengths:
                runs[x].append((times, base, at))
                at += x
            base += times
        keys, bases, offsets = [], [], []
        for x in sorted(runs):
            rank = 0
            for times, first, at in runs[x]:
                keys.append((x << 44) + rank)
                bases.append(first)
                offsets.append(at)
                rank += times
        self.keys, self.bases, self.offsets = (np.array(v, dtype=np.int64) for v in (keys, bases, offsets))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        i = np.searchsorted(self.keys, key, side="right") - 1
        return self.bases[i] + key - self.keys[i], self.offsets[i]


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = 20_000) -> DataFrame:
    """``pieces`` (any columns beside length and ``PLACES``) with sequence_id and offset instead of ``PLACES``."""
    part, rank = PLACES
    rows = scratch.materialise(pieces, "pieces")
    counts = scratch.materialise(rows.groupBy(part, "length").agg(F.count(F.lit(1)).alias("__n")), "piece-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # capacity rows at most
    place = Placement(solve(lengths, capacity, nodes))
    before = F.sum("__n").over(W.Window.partitionBy("length").orderBy(part)) - F.col("__n")
    ranked = rows.join(counts.select(part, "length", before.alias("__before")), [part, "length"])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col("__before")).select(*rows.drop(part).columns)
    schema = T.StructType([*rows.drop(*PLACES).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = place(b.column("length").to_numpy(), b.column(rank).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in schema.names[:-2]), *map(pa.array, where)], names=schema.names)

    return map_arrow(ranked, run, schema)
