"""From raw documents to packed training sequences, as five stages.

Each stage takes all rows its predecessor kept and is written as Parquet before the next
one reads it, so a lost executor costs at most the stage it worked on.
"""

from pyspark.sql import DataFrame, SparkSession

from voltlake.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from voltlake.session import configure, scratch_path


# Pieces of text that a worker of the last stage remembers: it runs beside heaps that the
# stages before have filled.
PIECES_KEPT = 200_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted on labelled rows, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_rows(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts: the one with the largest doc_id."""
    docs = exact_dedup.addressable(docs)
    return exact_dedup.kept_rows(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the one with the smallest doc_id."""
    return near_dedup.kept_rows(docs, near_dedup.near_dedup(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_rows(docs, decontaminate.contaminated(docs, benchmark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents left, each with its sequence and place there."""
    return packing.pack(docs, added=True, pieces_kept=PIECES_KEPT)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# The classifier and the plan of the packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
