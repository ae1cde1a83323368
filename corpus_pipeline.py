"""The corpus pipeline: quality rules, near duplicates, secret scans, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
applies the stages to ``documents``, writing and reading Parquet between them in the folder
that the cluster names in ``spark.checkpoint.dir``. Stages with Python steps set the session's Arrow
batches to 2,000 rows, so that JVM and Python hold few texts at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.llm import jaccard, mixing, packing, quality, secret_scan
from dwellpath.llm.spark import small_batches, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.score(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows without a doc_id can't be linked and stay. Rows of one doc_id are told apart by the keys
    of their sets; of rows that share doc_id and set, one stays.
    """
    small_batches(spark)
    groups = jaccard.join_components(docs, with_key=True).filter("doc_id is not null")
    first = groups.groupBy("component_id", (F.col("n_shingles") > 0).alias("linked")).agg(F.min(F.struct("doc_id", "key")).alias("first"))
    first = first.select("first.doc_id", F.col("first.key").alias("_key"))
    keyed = docs.filter("doc_id is not null").withColumn("_key", jaccard.set_key(F.col("text")))
    kept = keyed.join(first, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by the names of their kinds."""
    small_batches(spark)
    return secret_scan.redact(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more for a part of its words.

    The mix cuts at most one document of a source's shard; its first words go in once more,
    joined by single spaces. Documents that the mix doesn't take are dropped.
    """
    taken = mixing.mix_rows(docs.select(*COLUMNS)).filter("taken > 0")
    rows = taken.withColumn("copy", F.explode(F.expr("sequence(1, cast(taken div size + if(taken % size > 0, 1, 0) as int))")))
    whole = F.expr("copy <= taken div size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, F.lit(1), F.expr("cast(taken % size as int)")), " ")
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    return rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of a power of two tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", duplicate_stage),
    ("secret scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokens, components and entropy spans can't be had in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
