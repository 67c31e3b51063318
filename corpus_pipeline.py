"""A training corpus from raw documents: five stages, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``.  When a stage starts, what earlier stages of the same folder's run wrote for themselves is no longer
needed and goes, since their results have been written by then; tables of other runs and operators stay.

Defined results, in every stage: rows with a null or empty text stay (packing gives them one piece of one token); rows
with a null id stay and are compared with nothing; repeated rows are treated alike; an empty table gives no rows;
columns besides doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronowarp.llm import minhash, packing, pii, scratch, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _stage(work):
    """``work`` with its intermediate tables in the scope of the folder's run, cleared of what stages before it left."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.clear(spark, f"pipeline {sf_dir}")
        with scratch.scoped(f"pipeline {sf_dir}"):
            return work(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not call toxic."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


@_stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component at 0.8 over five-word shingles; rows without an id stay, and
    an id stays whole where one of its texts does."""
    found = minhash.near_duplicates(docs, k=5, percent=80).where("id is not null")
    gone = found.groupBy("id").agg(F.max("kept").alias("stays")).where("not stays").select(F.col("id").alias("gone"))
    gone = scratch.materialise(gone, "near-copies")
    rows = docs.select(F.col("doc_id").cast("long").alias("gone"), F.struct(*docs.columns).alias("row"))
    return rows.join(gone, "gone", "left_anti").select("row.*")


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier document's."""
    return _recounted(substring.remove(docs))


@_stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _recounted(pii.redact(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens."""
    pieces = packing.pieces(docs)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *packing.PLACES))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", keep_one_of_near_copies),
    ("substring", cut_repeats),
    ("pii", redact),
    ("packing", pack),
]
#: Forward-backward, chaining and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the cleaned ``documents``."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            scratch.drop(spark, before)
        before = path
    return docs
