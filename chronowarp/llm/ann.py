"""Nearest neighbours by largest inner product with additive quantisation.

``LEVELS`` codebooks of full width are fitted in turn to what the earlier ones leave of a bounded sample.  Every vector
is encoded by beam search over them; kept with its codes is the factor that rights the quantised vector's norm along
the vector.  A query makes one table of inner products with all code words, and a candidate's score is the sum of
``LEVELS`` look-ups times its factor.

Equal vectors are one candidate, which keeps its k + 1 smallest ids.  Queries and candidates are dealt to blocks by hash
and each block of queries meets each of candidates: every row is scored, none is gathered with more than a block.
Candidates go there as codes and factors alone, some twenty bytes each.  The ``rerank`` best of each query by look-up,
over all blocks, are joined with their vectors and scored exactly; the k best of those are the result.  Recall grows
with ``rerank``.

Defined results: unusable vectors (null, empty, zero, null or non-finite components) and rows with a null id neither
ask nor answer; vectors of each width are searched apart, with codebooks of their own; ties go to the smaller id; rows
that repeat an id are candidates each, though never of their own id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .arrowed import map_arrow
from . import scratch, vectors

LEVELS, WORDS, BEAM = 24, 256, 4
QUERY_BLOCK, BLOCK, RERANK = 1024, 8192, 384


def codebooks(sample: np.ndarray, levels: int = LEVELS, words: int = WORDS) -> np.ndarray:
    """(levels, words, width): k-means of the residuals, level by level."""
    rest, books = sample.copy(), []
    for level in range(levels):
        centres = vectors.kmeans(rest, words, rounds=6, seed=level)
        if len(centres) < words:
            centres = np.concatenate([centres, np.zeros((words - len(centres), sample.shape[1]))])
        rest = rest - centres[vectors.nearest(rest, centres)]
        books.append(centres)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, levels) by beam search: at each level the ``beam`` best sums so far are continued."""
    width = books.shape[2]
    rest = x.astype(np.float32)[:, None, :]  # what each sum so far leaves
    codes = np.zeros((len(x), 1, 0), dtype=np.int64)
    error = (rest * rest).sum(2)
    rows = np.arange(len(x))[:, None]
    for book in books.astype(np.float32):
        inner = (rest.reshape(-1, width) @ book.T).reshape(*error.shape, len(book))
        trial = (error[:, :, None] - 2 * inner + (book * book).sum(1)).reshape(len(x), -1)
        keep = min(beam, trial.shape[1])
        best = np.argpartition(trial, keep - 1, axis=1)[:, :keep]
        from_, word = best // len(book), best % len(book)
        codes = np.concatenate([codes[rows, from_], word[:, :, None]], axis=2)
        rest, error = rest[rows, from_] - book[word], trial[rows, best]
    return codes[np.arange(len(x)), np.argmin(error, axis=1)]


def _by_width(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each width among the vectors."""
    widths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, vectors.matrix(lists.take(pa.array(at)))


def _encoded(rows: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, members, width, codes, factor) of (id, v, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, codes, factor = np.zeros(len(b), dtype=np.int32), [b""] * len(b), np.ones(len(b))
            for at, whole in _by_width(b.column(1)):
                own = books[whole.shape[1]]
                flat = own.reshape(-1, own.shape[2])
                width[at] = whole.shape[1]
                for lo in range(0, len(at), 1024):
                    x, rows = whole[lo : lo + 1024], at[lo : lo + 1024]
                    c = encode(x, own)
                    made = flat[c + np.arange(own.shape[0]) * own.shape[1]].sum(1)
                    along = np.einsum("ij,ij->i", x, made)
                    factor[rows] = np.where(along > 0, (x * x).sum(1) / np.where(along > 0, along, 1), 1.0)
                    for i, row in zip(rows.tolist(), c.astype(np.uint8), strict=True):
                        codes[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(width), pa.array(codes, pa.binary()), pa.array(factor)], names=["id", "v", "members", "width", "codes", "factor"])

    kind = dict(rows.dtypes)["v"]
    return map_arrow(rows, run, f"id long, v {kind}, members array<long>, width int, codes binary, factor double")


def _looked_up(blocks: DataFrame, books: dict[int, np.ndarray], keep: int) -> DataFrame:
    """(query_id, id, guess): the ``keep`` best of each block (members: array of id, v, codes, factor; v: queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                members = members.values
                asks = members.field("codes").is_null().to_numpy(zero_copy_only=False)
                if asks.all() or not asks.any():
                    continue
                rest = members.filter(pa.array(~asks))
                own = books[width]
                levels, words, _ = own.shape
                codes = np.frombuffer(b"".join(rest.field("codes").to_pylist()), dtype=np.uint8).reshape(-1, levels).astype(np.int64)
                ids, factor = rest.field("id").to_numpy(), rest.field("factor").to_numpy().astype(np.float32)
                q_ids, q = members.filter(pa.array(asks)).field("id").to_numpy(), vectors.matrix(members.filter(pa.array(asks)).field("v"))
                for lo in range(0, len(q_ids), 256):
                    table = (q[lo : lo + 256] @ own.reshape(-1, width).T).astype(np.float32)
                    scores = np.zeros((len(table), len(ids)), dtype=np.float32)
                    for level in range(levels):
                        scores += table[:, codes[:, level] + level * words]
                    scores *= factor
                    n = min(keep, len(ids))
                    best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                    guess = np.take_along_axis(scores, best, axis=1).astype(np.float64)
                    columns = (np.repeat(q_ids[lo : lo + 256], n), ids[best].ravel(), guess.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "guess"])

    return map_arrow(blocks, run, "query_id long, id long, guess double")


def _scored(pairs: DataFrame) -> DataFrame:
    """(query_id, members, score) of (query_id, members, x, q): exact inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(len(b))
            for at, x in _by_width(b.column(2)):
                score[at] = np.einsum("ij,ij->i", x, vectors.matrix(b.column(3).take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["query_id", "members", "score"])

    return map_arrow(pairs.select("query_id", "members", "x", "q"), run, "query_id long, members array<long>, score double")


def search(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``table`` to each of its rows where ``queries`` (a
    condition on its columns) holds, by inner product, without the query's own id; the ``rerank`` best by look-up are
    scored exactly."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & vectors.usable("v"))
    first = lambda *by: W.Window.partitionBy(*by)
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    few = rows.withColumn("turn", F.row_number().over(first("h1", "h2").orderBy("id"))).where(F.col("turn") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("members"))
    classes = scratch.materialise(classes.select("id", "v", "members"), "classes")
    widths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    books = {w: codebooks(vectors.sample(classes.where(F.size("v") == w), "v")) for w in widths}
    coded = scratch.materialise(_encoded(classes, books), "codes")
    asked = scratch.materialise(rows.where("query").select("id", "v", F.size("v").alias("width")), "queries")
    n, m = coded.count(), asked.count()
    cells, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = coded.select("width", every(parts).alias("p"), dealt(cells).alias("c"), "id", F.lit(None).cast(dict(rows.dtypes)["v"]).alias("v"), "codes", "factor")
    right = asked.select("width", dealt(parts).alias("p"), every(cells).alias("c"), "id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("factor"))
    blocks = left.union(right).groupBy("width", "p", "c").agg(F.collect_list(F.struct("id", "v", "codes", "factor")).alias("members"))
    keep = max(rerank, k + 1)
    found = _looked_up(blocks.select("width", "members"), books, keep)
    best = found.withColumn("turn", F.row_number().over(first("query_id").orderBy(F.col("guess").desc(), "id"))).where(F.col("turn") <= keep)
    pairs = best.select("query_id", "id").join(coded.select("id", F.col("v").alias("x"), "members"), "id")
    pairs = pairs.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct(), "query_id")
    pairs = pairs.where(F.size("x") == F.size("q"))  # rows that repeat an id may differ in width
    exact = _scored(pairs).select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(first("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
