"""Exact deduplication with disk-backed streaming state.

A streaming query keeps one state row per digest in RocksDB and never expires it: how many
rows had the digest, the stable identifier of the row that stays, and the locator of its
content (file and row). Rows of one micro-batch are combined before the shuffle, so a text
that makes up a third of all rows costs one state update per task. Where a digest was seen
more than once, the whole bytes of the rows are compared with those at the locator; rows
that only share the digest form classes of their own.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlake.llm.text import ascii_lower, text_of
from voltlake.session import scratch_path, settle
from voltlake.sinks.files import is_directory

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Of an executor, for all its stores; the rest of the state is on disk.
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # Stores that a finished query leaves open are closed that soon.
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    # Else every partition's store sets aside megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Settings of the calling session that the streaming session takes over.
_TAKEN_OVER = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Sightings:
    """Where the running state of the digests is written, for one or many runs."""

    table: str
    checkpoint: str

    @classmethod
    def fresh(cls, spark: SparkSession) -> "Sightings":
        return cls(scratch_path(spark, "digests"), scratch_path(spark, "digest-state"))


def addressable(docs: DataFrame) -> DataFrame:
    """``docs`` as rows of Parquet files; other frames are written to the shared folder."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
    except AnalysisException:
        return settle(docs, "documents")
    return docs


def _locator(docs: DataFrame) -> tuple[str, str]:
    """Names for file and row that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    lead = "_"
    while {f"{lead}file", f"{lead}row"} & taken:
        lead += "_"
    return f"{lead}file", f"{lead}row"


def located(docs: DataFrame) -> DataFrame:
    """Addressable ``docs`` with the locator of each row's content, as ``_locator`` names it."""
    file, row = _locator(docs)
    place = docs.metadataColumn("_metadata")
    return docs.select("*", place["file_path"].alias(file), place["row_index"].alias(row))


def signatures(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One narrow row per document: identifier, digest of its normalised text, locator."""
    text = ascii_lower(text_of())
    file, row = _locator(docs)
    return located(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(text).cast("binary").alias("digest"),
        F.col(file).alias("_file"),
        F.col(row).alias("_row"),
    )


def observe(signed: str, spark: SparkSession, state: Sightings, files_per_batch: int) -> None:
    """Stream the signature files that have arrived since the last run into the state."""
    session = spark.newSession()
    for name in _TAKEN_OVER:
        session.conf.set(name, spark.conf.get(name))
    for name, value in _STATE_STORE.items():
        session.conf.set(name, value)
    schema = "doc_id bigint, digest binary, _file string, _row bigint"
    rows = (
        session.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(signed)
    )
    keep = F.max(F.struct("doc_id", "_file", "_row")).alias("keep")
    states = rows.groupBy("digest").agg(F.count("*").alias("seen"), keep)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state.table}/batch={batch}")

    (
        states.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", state.checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


_STATE_SCHEMA = (
    "digest binary, seen bigint, "
    "keep struct<doc_id: bigint, _file: string, _row: bigint>, batch int"
)


def states(spark: SparkSession, state: Sightings) -> DataFrame:
    """The newest state row of each digest."""
    rows = spark.read.schema(_STATE_SCHEMA).parquet(state.table)
    newest = rows.groupBy("digest").agg(F.max(F.struct("seen", "keep")).alias("s"))
    return newest.select("digest", "s.seen", "s.keep")


def _differing(docs: DataFrame, signed: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose digest was seen before but whose bytes differ from the kept row's."""
    hits = signed.join(repeated, "digest").select(
        "_file",
        "_row",
        "digest",
        "doc_id",
        F.struct("doc_id", "_file", "_row").eqNullSafe(F.col("keep")).alias("is_keep"),
    )
    file, row = _locator(docs)
    texts = located(docs).select(
        F.col(file).alias("_file"), F.col(row).alias("_row"), ascii_lower(text_of()).alias("norm")
    )
    found = texts.join(hits, ["_file", "_row"])
    found = settle(found, "hits")  # both sides of the comparison come from it
    kept = found.filter("is_keep").select("digest", F.col("norm").alias("kept_norm"))
    return (
        found.filter("NOT is_keep")
        .join(kept, "digest")
        .filter("norm <> kept_norm")
        .select("_file", "_row", "doc_id", "digest", "norm")
    )


def exact_dedup(
    docs: DataFrame,
    *,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """One row per row of ``docs``: the class of equal texts it belongs to.

    Returns ``doc_id``, ``keep_id`` (largest doc_id of the class), ``group_size``, ``kept``,
    the hexadecimal ``digest`` and the locator (``_file``, ``_row``). Texts are equal when
    identical after lower-casing A-Z only; null counts as empty. A null doc_id ranks below
    all others. Of rows tied on doc_id and text the one at the last locator stays, so
    exactly one row of a class is kept. Only doc_id and text are read, so other columns may
    have any name. No rows give no rows. Texts may be as long as Spark's rows allow.

    ``docs`` has to be ``addressable`` if the locators are to be used on it afterwards.
    """
    spark = docs.sparkSession
    docs = addressable(docs)
    signed_path = scratch_path(spark, "signatures")
    signatures(docs, digest).write.parquet(signed_path)
    signed = spark.read.parquet(signed_path)
    state = Sightings.fresh(spark)
    observe(signed_path, spark, state, files_per_batch)
    if not is_directory(spark, state.table):  # a stream without rows writes no state
        current = spark.createDataFrame([], _STATE_SCHEMA).drop("batch")
    else:
        # Stored, so that the joins with it have a shuffle of their own on both sides.
        current = settle(states(spark, state), "states")
    odd = settle(_differing(docs, signed, current.filter("seen > 1")), "differing")
    classes = signed.join(current, "digest")
    if not odd.isEmpty():
        classes = _split(classes, odd)
    me = F.struct("doc_id", "_file", "_row")
    return classes.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("seen").alias("group_size"),
        me.eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
        "_file",
        "_row",
    )


def _split(classes: DataFrame, odd: DataFrame) -> DataFrame:
    """Classes by whole text where one digest stands for several texts."""
    me = F.struct("doc_id", "_file", "_row")
    own = odd.groupBy("digest", "norm").agg(
        F.count("*").alias("own_seen"), F.max(me).alias("own_keep")
    )
    moved = odd.join(own, ["digest", "norm"]).select("_file", "_row", "own_seen", "own_keep")
    taken = odd.groupBy("digest").agg(F.count("*").alias("taken"))
    return (
        classes.join(moved, ["_file", "_row"], "left")
        .join(taken, "digest", "left")
        .withColumn(
            "seen", F.coalesce("own_seen", F.col("seen") - F.coalesce("taken", F.lit(0)))
        )
        .withColumn("keep", F.coalesce("own_keep", "keep"))
        .drop("own_seen", "own_keep", "taken")
    )


def kept_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of addressable ``docs`` that stay, with the columns they had."""
    file, row = _locator(docs)
    stay = verdicts.filter("kept").select(F.col("_file").alias(file), F.col("_row").alias(row))
    found = located(docs).join(stay, [file, row], "left_semi")
    return found.drop(file, row)
