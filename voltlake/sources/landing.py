"""Read landed files, and load them into bronze with one status row per source."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from voltlake import settings
from voltlake.functions.timeparts import at
from voltlake.sources import payloads as flat, schemas


def read_payloads(
    spark: SparkSession, path: str, loaded_at: datetime, *, whole_files: bool = False
) -> DataFrame:
    """Payload texts under ``path``, stamped with the load time.

    One payload per line by default, so large files split; ``whole_files`` is for
    responses stored as they came, one (possibly indented) document per file.
    """
    text = spark.read.text(path, wholetext=whole_files)
    return text.select(F.col("value").alias("payload"), at(loaded_at).alias("loaded_at"))


LOAD_DATE = "load_date"


def dated(df: DataFrame) -> DataFrame:
    """Adds the load date, by which bronze tables are partitioned."""
    return df.withColumn(LOAD_DATE, F.to_date("loaded_at"))


def read_bronze(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A bronze table under its declared schema; columns older files lack are NULL.

    ``load_date`` comes along, so that an increment reads only the days it needs.
    """
    schema = schemas.bronze_schema(table).add(LOAD_DATE, "date")
    return spark.read.schema(schema).parquet(path)


def append_bronze(df: DataFrame, path: str) -> None:
    dated(df).write.mode("append").partitionBy(LOAD_DATE).parquet(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Give a frame the declared columns of a bronze table, NULL where it has none."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.bronze_schema(table)
        ]
    )


def region_lookup(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Region names: the built-in 14, or a CSV file with a header."""
    if path is None:
        return spark.createDataFrame(settings.REGION_LOOKUP, schemas.REGION_LOOKUP)
    return spark.read.csv(path, header=True, schema=schemas.REGION_LOOKUP)


@dataclass(frozen=True)
class Source:
    """One feed: its payloads, how to flatten them, and the bronze table they go to."""

    name: str
    payloads: Callable[[], DataFrame]
    flatten: Callable[[DataFrame], DataFrame]
    target: str
    unit: str = "rows"
    note: Callable[[], str] | None = None


def priced_by(products: DataFrame) -> str:
    """The product to price by; fails when none qualifies."""
    row = flat.latest_product(products).first()
    if row is None or row[0] is None:
        raise ValueError("no eligible product found")
    return row[0]


def priced_source(
    name: str,
    payloads: Callable[[], DataFrame],
    products: Callable[[], DataFrame],
    target: str,
) -> Source:
    """The prices feed; its product is looked up while it loads, so that a products feed
    that fails stops this source and no other."""
    product = cache(lambda: priced_by(products()))
    return Source(
        name, payloads, lambda p: flat.flatten_prices(p, product()), target, "rates", product
    )


# Sources loaded at the same time, so that the few or last tasks of one leave no core idle.
CONCURRENT_LOADS = 4


def load_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Load every source; one that fails is reported and does not stop the others.

    Sources that share a target are loaded one after the other, in their order.

    Rows and payloads that are no JSON are counted by the write itself; a feed of nothing
    but the latter is an error. Returns (source, status, n_rows).
    """
    by_target: dict[str, list[int]] = {}
    for n, source in enumerate(sources):
        by_target.setdefault(source.target, []).append(n)

    def load(places: list[int]) -> list[tuple[int, tuple[str, str, int | None]]]:
        return [(n, _load(sources[n])) for n in places]

    with ThreadPoolExecutor(CONCURRENT_LOADS) as pool:
        loaded = dict(row for rows in pool.map(load, by_target.values()) for row in rows)
    statuses = [loaded[n] for n in range(len(sources))]
    return spark.createDataFrame(statuses, "source string, status string, n_rows long")


def _load(source: Source) -> tuple[str, str, int | None]:
    try:
        seen, read = Observation(f"load_{source.name}"), Observation(f"read_{source.name}")
        payloads = source.payloads().observe(read, *flat.readability())
        rows = source.flatten(payloads)
        append_bronze(rows.observe(seen, F.count(F.lit(1)).alias("n_rows")), source.target)
        n_rows, n_bad, n_read = seen.get["n_rows"], read.get["unreadable"], read.get["n_read"]
        if n_bad and n_bad == n_read:
            return source.name, f"ERROR — none of {n_read} payloads is JSON", None
        note = f" ({source.note()})" if source.note else ""
        bad = f", {n_bad} of {n_read} payloads are no JSON" if n_bad else ""
        return source.name, f"OK — {n_rows} {source.unit}{note}{bad}", n_rows
    except Exception as error:  # a feed may fail in any way; the audit row says how
        said = str(error).strip().splitlines()
        return source.name, f"ERROR — {said[0] if said else type(error).__name__}", None
