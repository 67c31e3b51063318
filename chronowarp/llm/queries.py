"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids by number and checksum, and the checksum of the text read back from them."""
    from . import pieces

    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    text, back = (F.crc32(F.coalesce(c, F.lit("")).cast("binary")) for c in ("text", "decoded"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), text.alias("text_crc32"), back.alias("decoded_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``."""
    from . import sharding

    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.93 within its label, and its component."""
    from . import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93).withColumnRenamed("id", "vec_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a sequence of at most 2048 tokens."""
    from . import packing

    pieces = packing.pieces(table(spark, sf_dir, "documents"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *packing.PLACES)
    return packing.pack(digest)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that repeats one of another document."""
    from . import substring

    return substring.passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component at 0.85 over three-word shingles."""
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).withColumnRenamed("id", "doc_id")


def _scored(operator, spark: SparkSession, sf_dir: str, label: str, folds: int, fold: int) -> DataFrame:
    from . import fitting

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    aside = fitting.held_out("doc_id", folds, fold)
    model = operator.fit(docs, labels.where(~aside).select("doc_id", label), label)
    return operator.score(docs, model).select("doc_id", aside.alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of one fold in three are not learned from."""
    from . import toxicity

    return _scored(toxicity, spark, sf_dir, "toxic", 3, 1)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of one fold in four are not learned from."""
    from . import quality

    return _scored(quality, spark, sf_dir, "quality", 4, 2)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors to every vector whose id is divisible by 20."""
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    from . import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (pii.counted("base_spans", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS))
    return found.select("doc_id", *counts, F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_quality, op3_embeddings, op4_packing, op5_substring, op6_minhash, op7_ann, op8_pii, op9_pieces, op10_sharding)
    return {f.__name__: f for f in own}


#: Ids that links reach, and the smallest of them.
_REACH = "both_ways as (select a, b from links union select b, a from links), reach as (select id, id r from nodes union select reach.id, b from reach join both_ways on a = r), named as (select id, min(r) c from reach group by id)"

MINHASH_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) x from d),
v as (select doc_id, len(x) n, unnest(x) y from s),
links as (select p.doc_id a, q.doc_id b from v p join v q on p.y = q.y and p.doc_id < q.doc_id group by p.doc_id, q.doc_id having 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
nodes as (select doc_id id from d),
{_REACH}
select s.doc_id, len(s.x) n_shingles, named.c component_id, named.c = s.doc_id kept from s join named on named.id = s.doc_id
"""

EMBEDDINGS_SQL = f"""
with recursive e as (select vec_id, label, [x::double for x in embedding] v from embeddings),
links as (select p.vec_id a, q.vec_id b from e p join e q on p.label = q.label and p.vec_id < q.vec_id where list_cosine_similarity(p.v, q.v) >= 0.93),
nodes as (select vec_id id from e),
{_REACH},
degree as (select a, count(*) n from both_ways group by a)
select e.vec_id, coalesce(degree.n, 0) n_links, named.c component_id, named.c = e.vec_id kept from e join named on named.id = e.vec_id left join degree on degree.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL for the two operators that it can express; the others are tested against brute force in
    Python, round trips or held-out labels."""
    return {"op3_embeddings": EMBEDDINGS_SQL, "op6_minhash": MINHASH_SQL}
