"""Queries of the corpus operators and the SQL that must give the same rows."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlake.llm import (
    decontaminate as leaks,
    exact_dedup as exact,
    licenses,
    line_dedup as lines,
    near_dedup as near,
    oracle,
    packing,
    periodic,
    quality,
    quality_rules as rules,
    spelling,
    substring_dedup as substrings,
    token_files,
    warc,
)
from voltlake.llm.tokens import id_checksums
from voltlake.session import configure, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


_register("op1_exact_dedup", _exact_dedup, oracle.EXACT_DEDUP)


def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(_documents(spark, sf_dir))


_register("op2_near_dedup", _near_dedup, oracle.NEAR_DEDUP)


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


_register("op3_line_dedup", _line_dedup, oracle.LINE_DEDUP)


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.drop("row")


_register("op4_decontamination", _decontamination)


def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_documents(spark, sf_dir), path)
    rows = token_files.with_starts(spark, path, token_files.read_tokens(spark, path))
    return id_checksums(rows, "doc_id", "start", "n_tokens")


_register("op5_token_files", _token_files)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


_register("op6_quality", _quality)


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_documents(spark, sf_dir))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


_register("op7_best_fit_packing", _packing)


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pages table has no further source headers.
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages"))).drop("headers")


_register("op8_warc_derivatives", _warc, oracle.WARC)


def _license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


_register("op9_license_scan", _license_scan, oracle.LICENSES)


def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_documents(spark, sf_dir)).drop("text_hash")


_register("op10_substring_dedup", _substring_dedup)


def _quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_documents(spark, sf_dir)).drop("chars_distance", "words_distance")


_register("op11_quality_rules", _quality_rules, oracle.QUALITY_RULES)


def _spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_documents(spark, sf_dir), slips=199)


_register("op12_spelling_groups", _spelling_groups, oracle.SPELLING_GROUPS)


def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_run_report(_documents(spark, sf_dir), planted=True))


_register("op13_periodic_runs", _periodic_runs, oracle.PERIODIC_RUNS)
_register("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
