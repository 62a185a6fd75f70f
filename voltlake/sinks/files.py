"""The few file-system calls the table writers need, on whatever system the path names."""

import time

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _resolve(spark, path)
    return fs.exists(where)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, where = _resolve(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it was there already. Only one caller gets True."""
    fs, where = _resolve(spark, path)
    fs.mkdirs(where.getParent())
    return fs.createNewFile(where)


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file was written; 0 if it has gone meanwhile."""
    fs, where = _resolve(spark, path)
    if not fs.exists(where):
        return 0.0
    return time.time() - fs.getFileStatus(where).getModificationTime() / 1000


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _resolve(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _resolve(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, replacing one that is there."""
    fs, where = _resolve(spark, path)
    out = fs.create(where, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, where = _resolve(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move_new(spark: SparkSession, path: str, target: str) -> bool:
    """Give a file a name; False if the name is taken or the move fails."""
    fs, where = _resolve(spark, path)
    to = _resolve(spark, target)[1]
    return not fs.exists(to) and fs.rename(where, to)
