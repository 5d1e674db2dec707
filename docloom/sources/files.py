"""Texts and JSON documents as files: read whole, written whole, listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files of a folder whose names match the pattern, by path; none if there is no folder."""
    schema = "path string, length long, modified timestamp"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files of a folder, each whole, as UTF-8; bytes that are none become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def load_text(spark: SparkSession, path: str, default: str = "") -> DataFrame:
    """One row, text: the file's, or the default where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([(default,)], "text string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def load_json(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """The rows of JSON by a schema: a file is one document or an array of them, a folder holds lines, as save_json() writes them. The default, or no rows, where there is nothing."""
    if not exists(spark, path):
        return default if default is not None else spark.createDataFrame([], schema)
    fs, at = _path(spark, path)
    return spark.read.schema(schema).json(path, multiLine=fs.getFileStatus(at).isFile())


def save_text(table: DataFrame, path: str, text: str = "text") -> str:
    """Writes a column's texts, a line each, into a folder, in place of what is there."""
    table.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)
    return path


def save_json(table: DataFrame, path: str) -> str:
    """Writes the rows as JSON lines with keys in order into a folder, in place of what is there."""
    table.select(*sorted(f"`{c}`" for c in table.columns)).write.mode("overwrite").json(path)
    return path
