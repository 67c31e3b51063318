"""Near-duplicate vectors with an inverted multi-index.

Equal labels only (of any type that can be grouped by), by cosine.  Vectors are scaled to length one, equal ones of a label become one class, and each half
has its own codebook, so that a pair of codes is a cell of a product grid.  The number of codes follows the number of
vectors, to keep cells of about ``CELL`` vectors.  From each vector a multi-sequence traversal visits cells, nearest
first by a lower bound on their distance (how far the bisecting plane between the own and the other centre is, in each
half), until every cell has been visited in which a partner is expected with the target recall.

A partner at the threshold lies at a distance r; the part of it along a given direction in d dimensions is r/sqrt(d)
on average over directions, so the bound must reach beyond ``SPREADS`` times that to be left out.  Planes are few,
and a link is found from either of its ends.  What lies in a visited cell is verified in double precision, in blocks:
the members and visitors of a cell are split by hash once either are many, so no cell is gathered whole.  A block gives on
how many links each vector has in it and a forest of them, not every pair.

Defined results: null labels and unusable vectors (null, empty, zero, null or non-finite components) link with
nothing and are their own component; vectors of different width never link; equal vectors link with each other;
repeated rows of one id are members each; a null id has a null component; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowed import map_arrow
from . import scratch, vectors
from .components import components

CELL, SPREADS, BLOCK = 64, 2.5, 1024
#: Distinct vectors that codebooks are fitted on: so many for each code, ``vectors.SAMPLE`` at least. Codes grow with the
#: square root of the largest label.
PER_CODE = 16


def planes(centres: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own code and, for every code, the distance to the plane between its own centre and that code's."""
    d = (centres**2).sum(1)[None, :] - 2 * np.einsum("ij,kj->ik", x, centres)  # to the bit alike in every batch
    own = np.argmin(d, axis=1)
    between = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-12))
    return own, np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * between[own])


def traverse(left: np.ndarray, right: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in order of left[i]**2 + right[j]**2 up to reach**2: multi-sequence over both sorted halves."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    la, lb = (left[a] ** 2).tolist(), (right[b] ** 2).tolist()
    heap, seen = [(la[0] + lb[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > reach * reach:
            return
        yield int(a[i]), int(b[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(la) and n[1] < len(lb) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (la[n[0]] + lb[n[1]], *n))


def _cells(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], reach: float) -> DataFrame:
    """(label, id, home, visits) of (label, id, v): the own cell and the others to visit."""
    width, side = books[0].shape[1] + books[1].shape[1], len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2)
            lengths = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, dtype=np.int64)
            fits = np.flatnonzero(lengths == width)
            homes = -lengths.astype(np.int64) - 1  # of another width than the index: a cell for each width
            visits: list[list[int]] = [[] for _ in lengths]
            for lo in range(0, len(fits), 1024):
                some = fits[lo : lo + 1024]
                x = vectors.matrix(rows.take(pa.array(some)))
                (own1, far1), (own2, far2) = (planes(c, part) for c, part in zip(books, (x[:, : books[0].shape[1]], x[:, books[0].shape[1] :]), strict=True))
                homes[some] = own1 * side + own2
                for n, row in enumerate(some.tolist()):
                    visits[row] = [c for i, j in traverse(far1[n], far2[n], reach) if (c := i * side + j) != homes[row]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(homes, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names=["label", "id", "home", "visits"])

    fields = [("label", classes.schema["label"].dataType), ("id", T.LongType()), ("home", T.LongType()), ("visits", T.ArrayType(T.LongType()))]
    return map_arrow(classes.select("label", "id", "v"), run, T.StructType([T.StructField(*f) for f in fields]))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b join two groups that earlier ones leave apart."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        keep[i] = x != y
        parent[x] = y
    return keep


def _verified(blocks: DataFrame, threshold: float, books: tuple[np.ndarray, np.ndarray], reach: float) -> DataFrame:
    """(a, b, n) of (cell, members: array of id, side, members, home, v).  With b: a link, of a forest of the block's.
    Without: ``n`` more rows that ``a`` is linked with.  A visitor counts what it finds at home in the cell; one at home
    counts a visitor itself only if it does not visit the other's cell in its turn."""
    half, side = books[0].shape[1], len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, counts = [], []
            for cell, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                members = members.values
                at_home = members.field("side").to_numpy(zero_copy_only=False)
                ids, many = members.field("id").to_numpy(), members.field("members").to_numpy()
                homes = members.field("home").to_numpy()
                x = vectors.matrix(members.field("v"))
                h, g = np.flatnonzero(at_home), np.flatnonzero(~at_home)
                if cell >= 0:  # how far those at home are from every plane
                    far1, far2 = (planes(c, part)[1] for c, part in zip(books, (x[h, :half], x[h, half:]), strict=True))
                for lo in range(0, len(g), BLOCK):
                    i, j = np.nonzero(x[g[lo : lo + BLOCK]] @ x[h].T >= threshold - 1e-9)
                    i, local = g[lo + i], j
                    j = h[local]
                    good = (np.einsum("ij,ij->i", x[i], x[j]) >= threshold) & (ids[i] != ids[j])
                    i, j, local = i[good], j[good], local[good]
                    keep = _forest(ids[i], ids[j])
                    links.append(np.stack([ids[i[keep]], ids[j[keep]]]))
                    counts.append(np.stack([ids[i], many[j]]))
                    alone = homes[i] != cell
                    if cell >= 0 and len(i):
                        one, two = np.divmod(homes[i], side)
                        alone &= far1[local, one] ** 2 + far2[local, two] ** 2 > reach * reach
                    counts.append(np.stack([ids[j[alone]], many[i[alone]]]))
            none = np.empty((2, 0), dtype=np.int64)
            a, b = np.concatenate(links or [none], axis=1)
            c, n = np.concatenate(counts or [none], axis=1)
            c, where = np.unique(c, return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(c)).astype(np.int64)
            columns = [np.concatenate([a, c]), pa.array([*b.tolist(), *[None] * len(c)], pa.int64()), pa.array([*[None] * len(a), *n.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *columns[1:]], names=["a", "b", "n"])

    return map_arrow(blocks, run, "a long, b long, n long")


def near_duplicates(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links by cosine >= threshold within a label."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", vectors.usable("x") & F.col("label").isNotNull() & F.col("id").isNotNull())
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    scaled = F.when(F.col("ok"), F.transform("x", lambda v: v / norm))
    rows = scratch.materialise(rows.select("id", "label", "ok", scaled.alias("v"), F.xxhash64("x").alias("h1"), F.hash("x").alias("h2")), "vectors")
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count(F.lit(1)).alias("members"))
    classes = scratch.materialise(classes, "classes")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = max(1, round((n / CELL) ** 0.5))
    width = classes.agg(F.mode(F.size("v"))).first()[0]
    trained = vectors.sample(classes.where(F.size("v") == F.lit(width)), "v", max(vectors.SAMPLE, PER_CODE * codes))
    found = classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("n")).limit(0)
    if len(trained):
        half = max(1, trained.shape[1] // 2) if trained.shape[1] > 1 else 1
        books = (vectors.kmeans(trained[:, :half], codes), vectors.kmeans(trained[:, half:], codes) if trained.shape[1] > half else np.zeros((1, 0)))
        reach = min(1.0, SPREADS / trained.shape[1] ** 0.5) * (2 - 2 * threshold) ** 0.5
        cells = scratch.materialise(_cells(classes, books, reach), "cells")
        visits = cells.select("label", "id", F.col("home").alias("cell"), F.lit(True).alias("home")).union(cells.select("label", "id", F.explode("visits"), F.lit(False)))
        visits = scratch.materialise(visits, "visits")
        sizes = visits.groupBy("label", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("hb"), F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("vb"))
        sizes = scratch.materialise(sizes.where("hb > 0"), "cell-sizes")
        placed = visits.join(sizes, ["label", "cell"])
        mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        # each home block meets each block of all that visit (those at home too)
        at_home = placed.where("home").select("label", "cell", "id", F.lit(True).alias("home"), mine("hb").alias("p"), F.explode(every("vb")).alias("q"))
        passing = placed.select("label", "cell", "id", F.lit(False).alias("home"), mine("vb").alias("q"), F.explode(every("hb")).alias("p")).select("label", "cell", "id", "home", "p", "q")
        known = cells.select("label", "id", F.col("home").alias("own")).join(classes.select("id", "label", "members", "v"), ["label", "id"])
        members = at_home.union(passing).join(scratch.materialise(known, "known"), ["label", "id"])
        item = F.struct("id", F.col("home").alias("side"), "members", F.col("own").alias("home"), "v")
        blocks = members.groupBy("label", "cell", "p", "q").agg(F.collect_list(item).alias("members")).select("cell", "members")
        found = scratch.materialise(_verified(blocks, threshold, books, reach), "links")
    links = found.where("b is not null").select("a", "b").distinct()
    degree = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    named = classes.join(components(links), "id", "left").join(scratch.materialise(degree, "degree"), "id", "left")
    named = named.select("label", "h1", "h2", F.coalesce("component", "id").alias("c"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("d"))
    named = scratch.materialise(named, "named")
    out = rows.select("id", "label", "ok", "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    component = F.when(F.col("ok"), F.col("c")).otherwise(F.col("id"))
    return out.select("id", F.when(F.col("ok"), F.col("d")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
