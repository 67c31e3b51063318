"""Repeated passages by collinear chaining of k-mer seeds.

Seeds are ``K``-word shingles thinned by minimizers: any run of ``WINDOW + K - 1`` equal words shares one.  A seed's
first place (smallest document id, then place) is its leader, and every place of it in other documents matches the
leader alone, so a seed in a third of all documents makes no more matches than it has places.  The matches of a document
(bounded by its own length) are chained for each leader document: ordered in both texts, best score by a Fenwick tree
of prefix maxima, with a gap cost linear in the words passed over.  Chains are aligned word by word: between seeds on
one diagonal or by their longest common subsequence, outwards until the score falls.  The best-scoring stretches, of
``SIMILARITY`` equal words, widened as far as that share holds, are copies of the leader's; a document's copies are joined where they meet or nearly do,
and those of ``LEAST_WORDS`` or more are its repeated passages.  What stands first, by document id, is never a repeat of what comes later.

Equal runs do not hang on a seed's leader.  Shingles of ``RUN`` words, thinned so that any run of ``LEAST_WORDS`` equal
words shares one, tell where a document may repeat another.  There, every shingle of ``RUN`` words is looked up, and one
that an earlier document holds is a copy by itself, of its first holder: each word of a run of ``LEAST_WORDS`` words
that stands in an earlier document lies in such a shingle, whichever documents hold parts of the run.

Seeds travel in blocks, not as rows: a block of texts says each of its seeds once, with its first holder; blocks' seeds
meet in buckets of the hash, and only what two documents hold is answered, to the blocks that hold it, where places are
looked up.  So a seed in every document weighs one entry a block, and a seed of one document ends in its bucket.

Documents of equal words are matched whole beforehand; only the one with the smallest id is searched.

Defined results: null, empty and short texts have no passages; repeats inside one document do not count; repeated rows
share an id and are no repeats of one another; rows with a null id are left out of the search; an empty table gives no
rows; columns of any name pass through ``remove``.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowed import map_arrow
from . import scratch, textops

K, WINDOW, LEAST_WORDS, SIMILARITY = 5, 4, 50, 0.8
#: Words of the shingles that are copies by themselves, and places among which one is sure to be chosen.
RUN = LEAST_WORDS // 2
RUN_WINDOW = LEAST_WORDS - RUN + 1
#: Chains of fewer words than this are chance or a short phrase, unless a seed of theirs recurs nearby: what has a
#: short period has few seeds, so that alignment decides.
LEAST_CHAIN, GAP_COST, FLANK, DROP, JOIN_WITHIN, GAP_CELLS = 12, 0.1, 64, 10, 10, 2500
#: Rows up to this number are sent to every executor; more are joined by a shuffle. Few, so that small tables are worked
#: on as large ones are. Numbers of documents left out take four bytes each.
BROADCAST_ROWS, BROADCAST_GONE = 5_000, 5_000_000
#: Seeds are matched in so many parts (a power of two) by their hash, one after the other, so that the disk holds the
#: shuffles of one.
PARTS = 4
#: Places of seeds go about in blocks of texts of so many bytes or documents, each one row, and seeds meet in buckets of
#: about so many a task.
BLOCK_BYTES, BLOCK_ROWS, BUCKET, LEAST_BUCKETS = 2 << 20, 1 << 16, 1 << 19, 12


def _small(df: DataFrame, lists: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, broadcast if it has few rows (``most``); where a column holds lists, their entries count."""
    n = df.agg(F.sum(F.size(lists))).first()[0] or 0 if lists else df.count()
    return F.broadcast(df) if n <= most else df


def _slide(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over x[i : i + w] for every i, by doubling; beyond the end lies ``fill``."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        out = op(out, np.concatenate([out[step:], np.full(step, fill, dtype=x.dtype)]))
        have += step
    return out


def minimizers(words: textops.Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all texts (hash, which text, place of the first word), at every place they are chosen, in order."""
    h = words.hashes
    top = np.iinfo(np.uint64).max
    counts = np.diff(words.first)
    run = np.full(len(h), top, dtype=np.uint64)
    if len(h) >= k:
        run[: len(h) - k + 1] = textops.rolled(h, k)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) + text * window  # a gap after each text
    inside = np.arange(len(h)) + k <= np.repeat(words.first[1:], counts)
    padded = np.full(len(h) + len(counts) * window, top, dtype=np.uint64)
    padded[place[inside]] = run[inside]
    least = _slide(padded, window, np.minimum, top)
    best = _slide(least[::-1], window, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero(inside & (best[place] == run))
    # chosen for being small; mixed again they are spread evenly
    return textops.mix(run[at]), text[at], (at - words.first[text[at]]).astype(np.int32)


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list of ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between each bound and the next."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


class _Blocks:
    """Places of seeds gathered from several texts into one row at a time: a number of its own in the table, ids of its
    documents, their word counts and digests, and by part of the seeds how many each document has, seeds and places."""

    TYPES = "block long, ids array<long>, n array<int>, d1 array<long>, d2 array<long>"

    def __init__(self, parts: list[str]):
        self.parts, self.number = parts, TaskContext.get().partitionId() << 32
        self._empty()

    @classmethod
    def schema(cls, parts: list[str]) -> str:
        return cls.TYPES + "".join(f", places{i} long, counts{i} binary, seeds{i} binary, at{i} binary" for i in parts)

    def _empty(self) -> None:
        self.docs, self.postings, self.bytes, self.rows = [], {i: [] for i in self.parts}, 0, 0

    def add(self, docs: tuple[np.ndarray, ...], postings: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
        """Documents (id, n, d1, d2) and, by part, their (seeds, which document, place) in order; a full row."""
        self.docs.append(docs)
        for i, (seeds, which, at) in postings.items():
            self.postings[i].append((np.bincount(which, minlength=len(docs[0])).astype(np.int32), seeds, at))
        self.bytes, self.rows = self.bytes + size, self.rows + len(docs[0])
        if self.bytes >= BLOCK_BYTES or self.rows >= BLOCK_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array([self.number], pa.int64())]
            columns += [_listed(np.concatenate(x), t) for x, t in zip(zip(*self.docs, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            names = ["block", "ids", "n", "d1", "d2"]
            for i in self.parts:
                lists = [np.concatenate(x) for x in zip(*self.postings[i], strict=True)]
                columns += [pa.array([len(lists[1])], pa.int64()), *(_cut(x, np.array([0, len(x)])) for x in lists)]
                names += [f"places{i}", f"counts{i}", f"seeds{i}", f"at{i}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            self.number += 1
            self._empty()


def _seeded(docs: DataFrame) -> DataFrame:
    """Blocks of (id, text): seeds by part of their hash, and as part ``_runs`` thinned shingles of ``RUN`` words."""
    parts = [*map(str, range(PARTS)), "_runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(parts)
        for b in batches:
            ids = b.column(0).to_numpy()
            for words in textops.chunks(b.column(1)):
                h, first = words.hashes, words.first
                n = np.diff(first)
                turn = textops.mix(h + (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                d1, d2 = (np.diff(np.cumsum(np.r_[np.uint64(0), x], dtype=np.uint64)[first]).view(np.int64) for x in (turn, textops.mix(turn)))
                seeds, which, at = minimizers(words)
                part = seeds & np.uint64(PARTS - 1)
                postings = {str(i): (seeds[mine], which[mine], at[mine]) for i in range(PARTS) for mine in (np.flatnonzero(part == i),)}
                yield from blocks.add((ids[words.rows], n, d1, d2), postings | {"_runs": minimizers(words, RUN, RUN_WINDOW)}, len(words.data))
        yield from blocks.rest()

    return map_arrow(docs, run, _Blocks.schema(parts))


def _settled(df: DataFrame, tag: str, since: list[str]) -> DataFrame:
    """``df`` written and read back; tables written for it (after ``since``) and shuffles no longer in use go."""
    out, spark = scratch.materialise(df, tag), df.sparkSession
    for path in scratch.paths(spark)[:-1]:
        if path not in since:
            scratch.drop(spark, path)
    _freed(spark)
    return out


def _freed(spark: SparkSession) -> None:
    """Shuffles no longer in use go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _places(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, id, place) of row ``i`` of (block, ids, gone, counts, seeds, at), without documents that are gone, by
    id and place."""
    ids = b.column(1)[i].values.to_numpy()
    counts, seeds, at = (np.frombuffer(b.column(k)[i].as_buffer(), dtype=t) for k, t in ((3, np.int32), (4, np.uint64), (5, np.int32)))
    which = np.repeat(np.arange(len(ids)), counts)
    if b.column(2)[i].is_valid:
        stays = np.ones(len(ids), dtype=bool)
        stays[b.column(2)[i].values.to_numpy()] = False
        stays = stays[which]
        seeds, which, at = seeds[stays], which[stays], at[stays]
    own = ids[which]
    if (np.diff(own) < 0).any():
        order = np.argsort(own, kind="stable")
        seeds, own, at = seeds[order], own[order], at[order]
    return seeds, own, at


def _answers(blocks: DataFrame, buckets: int, everywhere: bool) -> DataFrame:
    """(block, seeds, lids, lats) of (block, ids, gone, counts, seeds, at): the seeds of a block that two documents
    hold, with their leaders: the smallest id and the seed's first place in that document. Blocks in which only the leader
    holds a seed are told ``everywhere`` alone. A block says each seed once, however many documents hold it."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                seeds, own, at = _places(b, i)
                order = np.argsort(seeds, kind="stable")
                seeds = seeds[order]
                edge = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1], True]) if len(seeds) else np.zeros(1, dtype=np.int64)
                one, last = order[edge[:-1]], order[edge[1:] - 1]
                seeds, low = seeds[edge[:-1]], own[one]
                bucket = (seeds >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # rises with the seed
                new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(seeds) else np.zeros(1, dtype=np.int64)
                columns = [pa.array(bucket[new[:-1]].astype(np.int32)), pa.array(np.full(len(new) - 1, block), pa.int64())]
                columns += [_cut(x, new) for x in (seeds, low, at[one], own[last] != low)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "seeds", "low", "at", "more"])

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if len(b):
                seeds, n = _flat(b.column(2), np.uint64)
                parts.append((seeds, *(_flat(b.column(k), t)[0] for k, t in ((3, np.int64), (4, np.int32), (5, bool))), np.repeat(b.column(1).to_numpy(), n)))
        if not parts:
            return
        seeds, low, at, more, block = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(seeds)
        seeds, low, at, more, block = (x[order] for x in (seeds, low, at, more, block))
        new = np.r_[True, seeds[1:] != seeds[:-1]]
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        lid = np.minimum.reduceat(low, first)
        shared = (np.maximum.reduceat(low, first) != lid) | np.logical_or.reduceat(more, first)
        lat = np.minimum.reduceat(np.where(low == lid[which], at, np.iinfo(np.int32).max), first)
        told = np.flatnonzero(shared[which] if everywhere else shared[which] & (more | (low != lid[which])))
        told = told[np.argsort(block[told], kind="stable")]
        seeds, block, which = seeds[told], block[told], which[told]
        if len(told):
            new = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            yield pa.RecordBatch.from_arrays([pa.array(block[new[:-1]]), *(_cut(x, new) for x in (seeds, lid[which], lat[which]))], names=["block", "seeds", "lids", "lats"])

    said = map_arrow(blocks, firsts, "bucket int, block long, seeds binary, low binary, at binary, more binary")
    return map_arrow(said.repartitionById(buckets, "bucket"), leaders, "block long, seeds binary, lids binary, lats binary")


#: A block's places and leaders, each a list in bytes.
_LEADERS = "block long, id binary, lid binary, at binary, lat binary"


def _in_bytes(block: int, own: np.ndarray, lid: np.ndarray, at: np.ndarray, lat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(_cut(x, np.array([0, len(x)])) for x in (own, lid, at, lat))], names=["block", "id", "lid", "at", "lat"])


def _led(blocks: DataFrame, part: str, tag: str, everywhere: bool = False, form=_in_bytes, schema: str = _LEADERS) -> DataFrame:
    """(block, id, lid, at, lat) of blocks (with ``gone``, documents left out), in the ``form`` of ``schema``: places of
    seeds that an earlier document holds (``everywhere``: that two documents hold), with their leaders."""
    total = blocks.agg(F.sum(f"places{part}")).first()[0] or 0
    rows = blocks.select("block", "ids", "gone", f"counts{part}", f"seeds{part}", f"at{part}")
    answers = _answers(rows, max(min(LEAST_BUCKETS, 1 + total // 10_000), -(-total // BUCKET)), everywhere)
    answers = scratch.materialise(answers, tag).groupBy("block").agg(*(F.collect_list(c).alias(c) for c in ("seeds", "lids", "lats")))
    _freed(blocks.sparkSession)  # what blocks have said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                seeds, own, at = _places(b, i)
                known, lid, lat = (_flat(b.column(k)[i].values, t)[0] for k, t in ((6, np.uint64), (7, np.int64), (8, np.int32)))
                order = np.argsort(known)
                known = known[order]
                found = np.searchsorted(known, seeds).clip(max=len(known) - 1)
                hit = np.flatnonzero(known[found] == seeds)
                own, at, found = own[hit], at[hit], order[found[hit]]
                lid, lat = lid[found], lat[found]
                if not everywhere:
                    other = own != lid
                    own, at, lid, lat = own[other], at[other], lid[other], lat[other]
                yield form(block, own, lid, at, lat)

    return map_arrow(rows.join(answers.hint("merge"), "block"), run, schema)


def _near(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of every shingle of ``RUN`` words that starts less than ``RUN_WINDOW`` words from a thinned one which two
    documents hold."""

    def listed(_: int, own: np.ndarray, lid: np.ndarray, at: np.ndarray, lat: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(own[edge[:-1]]), lists], names=["id", "at"])

    at = _led(blocks, "_runs", "shared-runs", True, listed, "id long, at array<int>")
    at = scratch.materialise(at.groupBy("id").agg(F.flatten(F.collect_list("at")).alias("at")), "run-places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(["_near"])
        for b in batches:
            wanted, ids = b.column(2), b.column(0).to_numpy()
            for words in textops.chunks(b.column(1)):
                h, seeds, places = words.hashes, [], []
                for i, lo, hi in zip(words.rows, words.first[:-1], words.first[1:], strict=True):
                    n = int(hi - lo) - RUN + 1
                    start = np.empty(0, dtype=np.int64)
                    if n > 0:
                        change, found = np.zeros(n + 1, dtype=np.int64), wanted[i].values.to_numpy().astype(np.int64)
                        np.add.at(change, np.maximum(found - RUN_WINDOW + 1, 0).clip(max=n), 1)
                        np.add.at(change, (found + RUN_WINDOW).clip(max=n), -1)
                        start = np.flatnonzero(np.cumsum(change)[:n] > 0)
                        seeds.append(textops.rolled(h[lo:hi], RUN)[start])
                    places.append(start.astype(np.int32))
                which = np.repeat(np.arange(len(places)), [len(p) for p in places])
                none = np.zeros(len(places), dtype=np.int64)
                seeds = np.concatenate(seeds) if seeds else np.empty(0, dtype=np.uint64)
                yield from blocks.add((ids[words.rows], none, none, none), {"_near": (seeds, which, np.concatenate(places))}, len(words.data))
        yield from blocks.rest()

    return map_arrow(docs.join(_small(at, "at"), "id").select("id", "text", "at"), run, _Blocks.schema(["_near"]))


def _equal_runs(_: int, own: np.ndarray, lid: np.ndarray, at: np.ndarray, lat: np.ndarray) -> pa.RecordBatch:
    """(id, start, stop, lid) of matches: words under shingles of ``RUN`` words of one leader that meet."""
    order = np.lexsort((at, lid, own))
    own, lid, at = own[order], lid[order], at[order]
    new = np.ones(len(at) + 1, dtype=bool)
    new[1:-1] = (own[1:] != own[:-1]) | (lid[1:] != lid[:-1]) | (at[1:] > at[:-1] + RUN)
    edge = np.flatnonzero(new) if len(at) else np.zeros(1, dtype=np.int64)
    first, last = edge[:-1], edge[1:] - 1
    columns = [pa.array(own[first]), pa.array(at[first], pa.int32()), pa.array(at[last] + RUN, pa.int32()), pa.array(lid[first], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "start", "stop", "lid"])


class _PrefixMax:
    """Fenwick tree of the largest (value, index) among the first places."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chains(anchors: list[tuple[int, int]], k: int = K, gap: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Disjoint chains of anchors (x, y), each increasing in both, best first; anchors that fit none stand alone."""
    anchors = sorted(set(anchors))
    rank = {y: i for i, y in enumerate(sorted({y for _, y in anchors}))}
    tree, score, back = _PrefixMax(len(rank)), [0.0] * len(anchors), [-1] * len(anchors)
    waiting: list[int] = []  # of one x: they may not follow one another
    for i, (x, y) in enumerate(anchors):
        if waiting and anchors[waiting[0]][0] != x:
            for j in waiting:
                tree.put(rank[anchors[j][1]], (score[j] + gap * sum(anchors[j]), j))
            waiting = []
        best, j = tree.before(rank[y])
        score[i] = k
        if j >= 0:
            fresh = min(k, x - anchors[j][0], y - anchors[j][1])
            linked = best - gap * (x + y) + fresh
            if linked > k:
                score[i], back[i] = linked, j
        waiting.append(i)
    used, found = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = back[i]
        if chain:
            found.append(chain[::-1])
    return found


def recurring(anchors: list[tuple[int, int]], within: int = 2 * LEAST_CHAIN) -> set[tuple[int, int]]:
    """Anchors of a seed that stands in the document again at most ``within`` words away; longer periods have seeds
    enough for a chain. Of places fewer than ``LEAST_CHAIN`` words apart the first, since its alignment reaches the others."""
    found, last, kept = set(), {}, {}
    for x, y in sorted(set(anchors)):
        if y in last and x - last[y] <= within:
            for at in (last[y], x):
                if y not in kept or at - kept[y] >= LEAST_CHAIN:
                    kept[y] = at
                    found.add((at, y))
        last[y] = x
    return found


def _chained(matches: DataFrame) -> DataFrame:
    """(id, lid, x0, x1, y0, y1, xs, ys) of matches, one row a block: chains, the word ranges they may reach, their
    anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i in range(len(b)):
                own, lid, at, lat = (_flat(b.column(k)[i].values, t)[0] for k, t in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32)))
                if not len(own):
                    continue
                order = np.lexsort((lat, at, lid, own))
                own, lid, at, lat = own[order], lid[order], at[order], lat[order]
                new = np.r_[True, (own[1:] != own[:-1]) | (lid[1:] != lid[:-1])]
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                stop = np.r_[first[1:], len(own)]
                # a chain is too short where all of them would be, unless a seed recurs
                wide = np.minimum(at[stop - 1] - at[first], np.maximum.reduceat(lat, first) - np.minimum.reduceat(lat, first)) + K >= LEAST_CHAIN
                by_lat = np.lexsort((lat, group))
                same = np.flatnonzero((group[by_lat][1:] == group[by_lat][:-1]) & (lat[by_lat][1:] == lat[by_lat][:-1]))
                twice = np.zeros(len(first), dtype=bool)
                twice[group[by_lat][same]] = True
                for g in np.flatnonzero((wide | twice) & (stop - first > 1)).tolist():
                    lo, hi = first[g], stop[g]
                    anchors = list(zip(at[lo:hi].tolist(), lat[lo:hi].tolist(), strict=True))
                    again = recurring(anchors) if twice[g] else ()
                    for c in chains(anchors):
                        (x0, y0), (x1, y1) = c[0], c[-1]
                        if min(x1 - x0, y1 - y0) + K >= LEAST_CHAIN or again and any(a in again for a in c):
                            xs, ys = (np.array(v, dtype=np.int32).tobytes() for v in zip(*c, strict=True))
                            rows.append((int(own[lo]), int(lid[lo]), max(0, x0 - FLANK), x1 + K + FLANK, max(0, y0 - FLANK), y1 + K + FLANK, xs, ys))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "lid", "x0", "x1", "y0", "y1", "xs", "ys"])

    matches = matches.groupBy("block").agg(*(F.collect_list(c).alias(c) for c in ("id", "lid", "at", "lat")))
    return map_arrow(matches, run, "id long, lid long, x0 int, x1 int, y0 int, y1 int, xs binary, ys binary").distinct()


def _segments(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, a, b, words) for each wanted (id, a, b): the hashes of words a to b."""
    lists = scratch.materialise(ranges.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held, wanted, ids = 0, b.column(2).to_pylist(), b.column(0).to_pylist()
            for words in textops.chunks(b.column(1)):
                h = words.hashes
                for i, lo, hi in zip(words.rows, words.first[:-1], words.first[1:], strict=True):
                    for r in wanted[i]:
                        piece = h[lo + r["a"] : min(hi, lo + r["b"])].tobytes()
                        rows.append((ids[i], r["a"], r["b"], piece))
                        held += len(piece)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["id", "a", "b", "words"])

    return map_arrow(docs.join(_small(lists, "ranges"), "id").select("id", "text", "ranges"), run, "id long, a int, b int, words binary")


def _outwards(equal: np.ndarray) -> int:
    """How far to go along ``equal`` for the best sum (one for a match, -2 for none) before it falls by DROP."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > DROP)
    total = total[: fallen[0]] if len(fallen) else total
    return int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which words of ``x`` are on a longest common subsequence with ``y``; for gaps of a few words."""
    a, b = x.tolist(), y.tolist()
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    flags, i, j = np.zeros(len(a), dtype=bool), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            flags[i] = True
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return flags


def stretches(flags: np.ndarray, similarity: float, least: int) -> list[tuple[int, int]]:
    """Best-scoring stretches, when an unequal word costs what makes ``similarity`` break even: the best one, then
    those of what lies on either side, of ``least`` words or more."""
    found, todo = [], [(0, len(flags))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        total = np.r_[0, np.cumsum(np.where(flags[a:b], 1 - similarity, -similarity))]
        rise = total - np.minimum.accumulate(total)
        stop = int(np.argmax(rise))
        start = int(np.argmin(total[: stop + 1]))
        if stop - start >= least:
            found.append((a + start, a + stop))
            todo += [(a, a + start), (a + stop, b)]
    return sorted(found)


def widened(flags: np.ndarray, start: int, stop: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The longest range around a stretch, from one equal word to another, that keeps the share ``similarity`` of equal
    words and passes over at most ``JOIN_WITHIN`` unequal ones at a time."""

    def options(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far one may go, and the score there."""
        far = np.flatnonzero(side) + 1
        apart = np.flatnonzero(np.diff(far, prepend=0) > JOIN_WITHIN + 1)
        far = far[: apart[0]] if len(apart) else far
        return np.r_[0, far], np.r_[0, np.arange(1, len(far) + 1) - similarity * far]

    (left, lost), (right, lost_right) = options(flags[:start][::-1]), options(flags[stop:])
    score = flags[start:stop].sum() - similarity * (stop - start) + 1e-9
    best_from = np.maximum.accumulate(lost_right[::-1])[::-1]  # falls
    n = np.searchsorted(-best_from, lost + score, side="right") - 1
    i = int(np.argmax(np.where(n >= 0, left + right[n], -1)))
    return (start - int(left[i]), stop + int(right[n[i]])) if n[i] >= 0 else (start, stop)


def align(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int = K, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """The stretches of ``x`` (start, end) that copy ``y``, given chained anchors."""
    keep = (xs + k <= len(x)) & (ys + k <= len(y))
    xs, ys = xs[keep], ys[keep]
    if not len(xs):
        return []
    flags = np.zeros(len(x), dtype=bool)

    def on(diagonal: int, a: int, b: int) -> np.ndarray:
        return x[a:b] == y[a + diagonal : b + diagonal]

    d = (ys - xs).tolist()
    a = int(xs[0])
    n = min(a, a + d[0])
    left = a - _outwards(on(d[0], a - n, a)[::-1])
    flags[left:a] = on(d[0], left, a)
    for i in range(len(xs)):
        start = int(xs[i])
        flags[start : start + k] = True
        if i + 1 < len(xs):
            stop = int(xs[i + 1])
            if d[i] == d[i + 1]:
                flags[start:stop] = on(d[i], start, stop)
            elif stop > start + k:  # words put in or left out
                lo, y0, y1 = start + k, start + k + d[i], stop + d[i + 1]
                if (stop - lo) * max(y1 - y0, 0) <= GAP_CELLS:
                    flags[lo:stop] = _in_order(x[lo:stop], y[y0 : max(y0, y1)])
                else:  # change diagonals where most words agree
                    one, two = np.zeros(stop - lo, dtype=bool), np.zeros(stop - lo, dtype=bool)
                    hi = max(lo, min(stop, len(y) - d[i]))
                    one[: hi - lo] = on(d[i], lo, hi)
                    from_ = min(stop, max(lo, -d[i + 1]))
                    two[from_ - lo :] = on(d[i + 1], from_, stop)
                    cut = int(np.argmax(np.r_[0, np.cumsum(one)] + np.r_[np.cumsum(two[::-1])[::-1], 0]))
                    flags[lo : lo + cut], flags[lo + cut : stop] = one[:cut], two[cut:]
    e = int(xs[-1]) + k
    n = min(len(x) - e, len(y) - e - d[-1])
    right = e + _outwards(on(d[-1], e, e + n))
    flags[e:right] = on(d[-1], e, right)
    found = stretches(flags[left:right], similarity, LEAST_CHAIN)
    return [(left + a, left + b) for a, b in sorted({widened(flags[left:right], *s, similarity) for s in found})]


def _copies(chained: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, start, stop, lid): word ranges of ``id`` that copy ``lid``."""
    x = segments.select("id", F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("words").alias("x"))
    y = segments.select(F.col("id").alias("lid"), F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("words").alias("y"))
    both = chained.join(x.hint("merge"), ["id", "x0", "x1"]).join(y.hint("merge"), ["lid", "y0", "y1"]).select("id", "lid", "x0", "y0", "xs", "ys", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for own, lid, x0, y0, xs, ys, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = [np.frombuffer(v, dtype=np.int32).astype(np.int64) - o for v, o in ((xs, x0), (ys, y0))]
                for start, stop in align(np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64), *at):
                    rows.append((own, x0 + start, x0 + stop, lid))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["id", "start", "stop", "lid"])

    return map_arrow(both, run, "id long, start int, stop int, lid long")


def joined(copies: list[tuple[int, int, int]], least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """Word ranges (start, stop, source) made of copies at most ``JOIN_WITHIN`` words apart that cover the share
    ``similarity`` of the range at least, of ``least`` words or more; the source is that of the longest copy."""
    out: list[list[int]] = []  # start, stop, source, its length, words covered
    for start, stop, lid in sorted(copies):
        if out:
            last = out[-1]
            covered = last[4] + max(0, stop - max(start, last[1]))
            end = max(stop, last[1])
            if start <= last[1] + JOIN_WITHIN and covered >= similarity * (end - last[0]):
                source = [lid, stop - start] if stop - start > last[3] else last[2:4]
                out[-1] = [last[0], end, *source, covered]
                continue
        out.append([start, stop, lid, stop - start, stop - start])
    return [(o[0], o[1], o[2]) for o in out if o[1] - o[0] >= least]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, n_words, other_id): every passage, in code points, that repeats one of ``other_id``."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null")
    spark = docs.sparkSession
    seeded = scratch.materialise(_seeded(docs), "seeds")
    seeds_at = scratch.paths(spark)[-1]
    each = seeded.select("block", F.posexplode(F.arrays_zip("ids", "n", "d1", "d2")).alias("place", "x"))
    each = each.select("block", "place", F.col("x.ids").alias("id"), "x.n", "x.d1", "x.d2").where(f"n >= {K}")
    groups = each.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    groups = scratch.materialise(groups.where("members > 1").drop("members"), "equal-words")
    whole = each.join(_small(groups), ["n", "d1", "d2"]).where("id <> rep").select("block", "place", "id", "n", "rep")
    whole = scratch.materialise(whole, "whole-copies")

    gone = scratch.materialise(whole.groupBy("block").agg(F.collect_list("place").alias("gone")), "gone")
    whole = whole.select("id", "n", "rep").distinct()
    searched = seeded.join(_small(gone, "gone", BROADCAST_GONE), "block", "left")
    held = scratch.paths(spark)
    near = _near(docs, searched)
    places = [path for path in scratch.paths(spark) if path not in held]
    _freed(spark)
    matches = []
    for part in range(PARTS):
        held = scratch.paths(spark)
        matches.append(_settled(_led(searched, str(part), "leaders"), "matches", held))
    scratch.drop(spark, seeds_at)  # before every shingle near a run is sorted and texts are shuffled
    held = scratch.paths(spark)
    chained = _settled(_chained(reduce(DataFrame.unionAll, matches)), "chains", held[: -len(matches)])
    held = [path for path in scratch.paths(spark) if path not in places]
    near = scratch.materialise(near, "near-runs").withColumn("gone", F.lit(None).cast("array<int>"))
    _freed(spark)  # texts
    runs = _settled(_led(near, "_near", "run-leaders", False, _equal_runs, "id long, start int, stop int, lid long"), "equal-runs", held)
    ranges = chained.select("id", F.col("x0").alias("a"), F.col("x1").alias("b")).union(chained.select("lid", "y0", "y1"))
    held = scratch.paths(spark)
    segments = _settled(_segments(docs, ranges.distinct()), "segments", held)
    copies = _copies(chained, segments).union(runs).union(whole.where(f"n >= {LEAST_WORDS}").select("id", F.lit(0).alias("start"), F.col("n").alias("stop"), F.col("rep").alias("lid")))
    copies = copies.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "lid")).alias("copies"))
    copies = scratch.materialise(copies, "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            ids, found = b.column(0).to_pylist(), b.column(2).to_pylist()
            for words in textops.chunks(b.column(1)):
                spans = [(j, ids[i], int(lo), *s) for j, (i, lo) in enumerate(zip(words.rows, words.first[:-1], strict=True)) for s in joined([(c["start"], c["stop"], c["lid"]) for c in found[i]])]
                if spans:
                    text, lo, a, e = (np.array([s[k] for s in spans]) for k in (0, 2, 3, 4))
                    ends = words.points(np.concatenate([words.starts[lo + a], words.ends[lo + e - 1]]), np.concatenate([text, text]))
                    rows += [(s[1], int(ends[n]), int(ends[len(spans) + n]), s[4] - s[3], s[5]) for n, s in enumerate(spans)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "end", "n_words", "other_id"])

    out = "id long, start int, end int, n_words int, other_id long"
    return map_arrow(docs.join(_small(copies, "copies"), "id").select("id", "text", "copies"), run, out).distinct()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (same columns) without their repeated passages; rows of which nothing but white space is left go."""
    found = passages(docs, id_col, text_col)
    spans = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = scratch.materialise(spans, "passages")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(_small(spans), "id", "left")
    text = F.col("text")

    def before(i: Column) -> Column:
        """The end of the span before."""
        return F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)

    pieces = F.transform("spans", lambda x, i: text.substr(before(i) + 1, x["start"] - before(i)))
    left = F.concat(F.array_join(pieces, ""), text.substr(F.element_at("spans", -1)["end"] + 1, F.length(text)))
    rows = rows.withColumn("left", F.when(F.col("spans").isNotNull(), left)).where(F.col("spans").isNull() | F.col("left").rlike(r"\S"))
    changed = F.when(F.col("spans").isNotNull(), F.col("left")).otherwise(text)
    return rows.select(*(changed.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
