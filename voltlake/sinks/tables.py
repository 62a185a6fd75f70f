"""Where results go: rebuilt tables, views and JSON rows."""

from pyspark.sql import DataFrame


def rebuild(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Replace the whole table at ``path`` and return it as stored."""
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *partition_by)
    writer.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish_view(df: DataFrame, name: str) -> None:
    """A session view; nothing is computed."""
    df.createOrReplaceTempView(name)


def text_times(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, the form the JSON rows carry."""
    timed = {"timestamp", "timestamp_ntz", "date"}
    return df.select(
        *[
            df[name].cast("string").alias(name) if kind in timed else df[name]
            for name, kind in df.dtypes
        ]
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields kept."""
    text_times(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
