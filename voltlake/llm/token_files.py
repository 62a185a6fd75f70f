"""Token ids in Parquet files made for partial reads.

Rows stand in ascending doc_id order, so row groups and pages cover narrow id ranges and
their statistics (kept in the page index) let a reader fetch the ids of few documents.
Ids are a list column with a dictionary (two bytes an id or less); document ids, lengths
and starts are delta encoded and can be read without touching the ids.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voltlake.llm.text import small_batches
from voltlake.llm.tokens import END_ID, id_lists, token_batches, tokenizer_path

SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """How the files are cut. Sizes are bytes before compression, as the writer counts."""

    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            # Version 2 pages delta encode integers that have no dictionary.
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": "true",
        }


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    layout: Layout = Layout(),  # noqa: B008
    added: bool = True,
) -> None:
    """Encode every whole text and write one row per row of ``docs``.

    The tokenizer file's added tokens in a text become their own ids, unless ``added`` is
    false: then they are text like other.

    Null text is empty and gets the end id alone. Rows tied on doc_id stand in order of
    their text; a null doc_id comes first. Other columns are not read. No rows make an
    empty table. Texts are moved to their place in the order before they are encoded, and
    encoded in runs of a few megabytes, so memory does not grow with the table.
    """
    model = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for rows, ids in token_batches(batches, model, end_id, added):
            sizes = np.array([len(i) for i in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.record_batch(
                [
                    rows.column("doc_id"),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(starts),
                    pa.array(sizes),
                    id_lists(ids),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )

    placed = (
        small_batches(docs)
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    placed.mapInArrow(encode, SCHEMA).write.options(**layout.options()).parquet(path)


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """The rows of a document range; ids are only read if selected from the result."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` of the table with ``start``: the ids of all documents before.

    Each part's total is one row, so the running sum over parts is short.
    """
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    bases = totals.select("part", before.alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn(
        "start", F.col("base") + F.col("part_start")
    )
