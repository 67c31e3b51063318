"""MinHash near-duplicate search with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct k-word shingles; its sketch is the ``SKETCH`` smallest.  Equal sets
are one class.  The smallest ``LISTED`` values of each class are put in inverted lists, whose co-members overlap:

* cold lists (at most ``COLD`` classes): union-sketch estimates of all co-members; a pair of whole sets is decided on
  the spot, other pairs whose estimate lies within five standard errors of the threshold are confirmed on full sets;
* hot lists (a common passage, a large group of near copies): only classes with few cold values need them, as any two
  similar classes of which one has many cold values share a cold one.  Of these, a class of whose full set more than
  the share 1 - J is held by no other of them can be similar to none, and leaves; what else is there is counted again
  without it, until hardly any leave.  The full sets of the others are compared in blocks.  A first pass takes each
  block with a few pivots of the list; the second leaves out what is then known to be connected, and compares the rest
  with everything in the list.

Two sets at the threshold J miss each other in the lists with a probability of about (1-J)**8 at most (``listed`` and
``hot_listed`` make that smaller).  Only links that join two components are kept, which loses no component.  Estimates
never decide a link; full sets do.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing; fewer than k
words: the whole sequence is one shingle; repeated rows are members of one class; a null id is a member without a
voice in the component's name (null if no other member has one); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowed import map_arrow
from . import scratch, textops
from .components import components

SKETCH, LISTED, COLD, FEW_COLD, HOT_LISTED = 64, 16, 48, 10, 8
BLOCK, BLOCK_BYTES, PIVOTS = 1024, 8 << 20, 8
#: Ids up to this number are sent to every executor (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SKETCHES = "id long, n long, s1 long, s2 long, sketch binary"


def _small(df: DataFrame) -> DataFrame:
    """``df`` (ids; already written) marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def sketches(docs: DataFrame, k: int, size: int = SKETCH) -> DataFrame:
    """(id, n, s1, s2, sketch) of (id, text): set size, two sums that name the set, its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0xA24BAED4963EE407)
        for b in batches:
            n, s1, s2, low = [], [], [], []
            for words in textops.chunks(b.column(1)):
                for run in words.shingles(k):
                    u = np.unique(run)
                    v = u.view(np.uint64)
                    n.append(len(u))
                    s1.append(int(textops.mix(v).sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(textops.mix(v ^ salt).sum(dtype=np.uint64).view(np.int64)))
                    low.append(u[:size].tobytes())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "sketch"])

    return map_arrow(docs, run, _SKETCHES)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set) of (id, text): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(r).tobytes() for words in textops.chunks(b.column(1)) for r in words.shingles(k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return map_arrow(docs, run, "id long, set binary")


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right:
        return out
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    shared = np.flatnonzero(np.bincount(code, minlength=len(values)) > 1)
    place = np.full(len(values), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    column = place[code]
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        dense = np.zeros((len(left) + len(right), min(4096, len(shared) - at)), dtype=np.float32)
        dense[rows[lo:hi], column[lo:hi] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _forest(a: list, b: list, parent: dict) -> list[bool]:
    """Which of the links a-b join two components, given and updated in ``parent``."""

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        keep.append(x != y)
        parent[x] = y
    return keep


def _cold_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) of lists (members: array of id, n, sketch): decided links and pairs to be confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for members in batch.column(0).to_pylist():
                ids, n = [m["id"] for m in members], np.array([m["n"] for m in members])
                low = [np.frombuffer(m["sketch"], dtype=np.int64) for m in members]
                shared = _overlap(low, low)
                whole = np.array([len(s) == c for s, c in zip(low, n, strict=True)])
                top = np.array([np.iinfo(np.int64).max if w else s[-1] for s, w in zip(low, whole, strict=True)])
                below = np.stack([np.searchsorted(s, np.minimum(top, t), side="right") for s, t in zip(low, top, strict=True)])
                union = below + below.T - shared  # of both sketches, up to where both are complete
                sure = whole[:, None] & whole[None, :]
                estimate = shared / np.maximum(union, 1)
                j = percent / 100
                near = (estimate >= j - 5 * np.sqrt(j * (1 - j) / np.maximum(union, 1))) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
                linked = np.where(sure, 100 * shared >= percent * union, near)
                i, k = np.nonzero(np.triu(linked, 1))
                certain = sure[i, k]
                parent: dict = {}
                keep = _forest([ids[x] for x in i[certain]], [ids[x] for x in k[certain]], parent)
                out += [(ids[x], ids[y], True) for x, y, z in zip(i[certain], k[certain], keep, strict=True) if z]
                out += [(ids[x], ids[y], False) for x, y in zip(i[~certain], k[~certain], strict=True)]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "sure"])

    return map_arrow(lists, run, "a long, b long, sure boolean")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose full sets are similar enough."""
    left = docs.withColumnRenamed("id", "a").join(_small(pairs), "a").withColumnRenamed("text", "text_a")
    right = docs.join(_small(scratch.materialise(pairs.select(F.col("b").alias("id")).distinct(), "ids", pairs.count())), "id", "left_semi")
    both = left.join(right.withColumnsRenamed({"id": "b", "text": "text_b"}).hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                sides.append([np.unique(r) for words in textops.chunks(column) for r in words.shingles(k)])
            keep = []
            for x, y in zip(*sides, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def _supported(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of the written ``sets`` (id, set) that can be similar to another: enough of their elements are held by
    other rows too. Counting again without those that leave lets others leave; rounds end when few do."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(s, dtype=np.int64) for s in b.column(1).to_pylist()]
            if found:
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), ids], names=["element", "id"])

    n = sets.count()
    while n:
        held = map_arrow(sets, elements, "element long, id long").groupBy("element").agg(F.min("id").alias("id"), F.max("id").alias("last"))
        alone = scratch.materialise(held.where("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("alone")), "unshared", n)
        size = F.octet_length("set") / 8
        left = sets.join(_small(alone), "id", "left").where(100 * (size - F.coalesce("alone", F.lit(0))) >= percent * size).select("id", "set")
        sets, before = scratch.materialise(left, "supported"), n
        n = sets.count()
        if n > 0.9 * before:
            break
    return sets


def _block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links between the sides (0 and 1; 2: both) of each group of (key..., id, side, comp, set), a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for members in batch.column(0).to_pylist():
                sides = [[m for m in members if m["side"] in (s, 2)] for s in (0, 1)]
                left, right = ([np.frombuffer(m["set"], dtype=np.int64) for m in s] for s in sides)
                shared = _overlap(left, right)
                size = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
                comp = [np.array([m["comp"] for m in s], dtype=np.int64) for s in sides]
                linked = (100 * shared >= percent * (size - shared)) & (comp[0][:, None] != comp[1][None, :])
                i, j = np.nonzero(linked)
                keep = _forest(comp[0][i].tolist(), comp[1][j].tolist(), {})
                found += [(sides[0][x]["id"], sides[1][y]["id"]) for x, y, z in zip(i, j, keep, strict=True) if z]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(blocks.select("members"), run, "a long, b long")


def _hot_links(hot: DataFrame, docs: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among classes that share a hot value; ``hot``: written (value, id)."""
    n = hot.count()
    ids = scratch.materialise(hot.select("id").distinct(), "hot-ids", n)
    sets = _supported(scratch.materialise(full_sets(docs.join(_small(ids), "id", "left_semi"), k), "hot-sets"), percent)
    ids = scratch.materialise(sets.select("id"), "supported-ids", n)
    hot = scratch.materialise(hot.join(_small(ids), "id", "left_semi").select("value", "id"), "hot-supported", n)
    n = hot.count()

    def members(*keys: str):
        return F.collect_list(F.struct("id", "side", "comp", "set")).alias("members")

    def placed(rows: DataFrame, groups: list[str]) -> DataFrame:
        """Rows with ``blocks``, how many blocks their group needs, and ``block``."""
        size = rows.join(sets.select("id", F.octet_length("set").alias("bytes")), "id").groupBy(*groups).agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
        )
        return rows.join(scratch.materialise(size, "hot-sizes", n), groups).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    first = placed(hot, ["value"])
    pivots = first.select("value", "block").distinct().join(_pivots(hot), "value").select("value", "block", "id")
    rows = first.select("value", "block", "id").union(pivots).distinct()
    rows = rows.join(sets, "id").select("value", "block", "id", F.lit(2).alias("side"), F.col("id").alias("comp"), "set")
    near = scratch.materialise(_block_links(rows.groupBy("value", "block").agg(members()), percent), "hot-first")

    joined = components(links.select("a", "b").union(near))
    labelled = hot.join(joined, "id", "left").select("value", "id", F.coalesce("component", "id").alias("comp"))
    labelled = scratch.materialise(labelled, "hot-labelled", n)
    main = labelled.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.max_by("comp", "n").alias("main"))
    labelled = labelled.join(scratch.materialise(main, "hot-main", n), "value").withColumn("rest", F.col("comp") != F.col("main"))
    labelled = scratch.materialise(placed(labelled, ["value", "rest"]), "hot-placed", n)
    counts = labelled.groupBy("value").agg(F.max(F.when(F.col("rest"), F.col("blocks"))).alias("r"), F.max(F.when(~F.col("rest"), F.col("blocks"))).alias("m"))
    labelled = labelled.join(scratch.materialise(counts.where("r is not null"), "hot-counts", n), "value")
    others = labelled.where("rest").withColumn("o", F.col("block"))
    lower = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda p: F.struct(F.least("o", p).alias("o"), F.lit("r").alias("kind"), F.greatest("o", p).alias("p"), F.when(p == F.col("o"), 2).when(F.col("o") < p, 0).otherwise(1).alias("side")))
    across = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda p: F.struct(F.col("o").alias("o"), F.lit("m").alias("kind"), p.alias("p"), F.lit(0).alias("side")))
    against = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda o: F.struct(o.alias("o"), F.lit("m").alias("kind"), F.col("block").alias("p"), F.lit(1).alias("side")))
    sent = others.select("value", "id", "comp", F.explode(F.concat(lower, across)).alias("to")).union(labelled.where("not rest").select("value", "id", "comp", F.explode(against).alias("to")))
    rows = sent.join(sets, "id").select("value", "to.o", "to.kind", "to.p", "id", "to.side", "comp", "set")
    return near.union(_block_links(rows.groupBy("value", "o", "kind", "p").agg(members()), percent))


def _pivots(hot: DataFrame) -> DataFrame:
    """(value, id): up to ``PIVOTS`` members of each list, one for each of as many parts of it at random."""
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS))
    return hot.groupBy("value", part.alias("part")).agg(F.min("id").alias("id")).select("value", "id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED, hot_listed: int = HOT_LISTED) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``: sets of k-word shingles are linked when
    100 * intersection >= percent * union; kept is true for the row whose id names the component. ``listed``: retained
    values of each class in inverted lists, of ``SKETCH``; ``hot_listed``: those among long lists that are followed."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = scratch.materialise(sketches(docs, k), "sketches")
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.min_by("sketch", "id").alias("sketch"))
    classes = scratch.materialise(classes.where("id is not null"), "classes")
    n = classes.count()

    value = F.explode(F.expr(f"transform(sequence(0, least({listed}, octet_length(sketch) div 8) - 1), i -> substring(sketch, i * 8 + 1, 8))"))
    postings = classes.select(value.alias("value"), "id")
    sizes = scratch.materialise(postings.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "list-sizes", n * listed)
    shared = scratch.materialise(postings.join(sizes, "value"), "postings")
    lists = shared.where(f"size <= {COLD}").groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids").distinct()
    lists = lists.select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("id"))
    lists = scratch.materialise(lists, "lists")
    members = F.collect_list(F.struct("id", "n", "sketch")).alias("members")
    cold = lists.join(classes.select("id", "n", "sketch"), "id").groupBy("list").agg(members).select("members")
    pairs = scratch.materialise(_cold_pairs(cold, percent).distinct(), "pairs", n * listed)
    links = pairs.where("sure").select("a", "b")
    open_pairs = pairs.where("not sure").select("a", "b")
    first = scratch.materialise(open_pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs-first", n)
    links = links.union(scratch.materialise(_confirm(first, docs, k, percent), "links-first"))
    named = scratch.materialise(components(links), "components", n)
    left = open_pairs.join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        left = left.join(named.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    left = left.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    links = links.union(scratch.materialise(_confirm(scratch.materialise(left, "pairs-left", n * listed), docs, k, percent), "links-left"))

    hot = shared.where(f"size > {COLD}")
    few = hot.groupBy("id").agg(F.count(F.lit(1)).alias("n_hot"), F.slice(F.array_sort(F.collect_list("value")), 1, hot_listed).alias("values"))
    few = few.join(classes.select("id", "n"), "id").where(f"least(n, {listed}) - n_hot < {FEW_COLD}")
    hot = scratch.materialise(few.select(F.explode("values").alias("value"), "id"), "hot", n * hot_listed)
    if not hot.isEmpty():
        links = links.union(scratch.materialise(_hot_links(hot, docs, links, k, percent), "hot-links"))
    named = components(links)
    named = classes.join(named, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component_id"))
    named = scratch.materialise(named, "class-components", n)
    out = rows.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
