"""Lines in, lines and JSON lines out, and an inventory of model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines(text): a row per line, without the carriage return of other systems."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("text"))


def write_lines(df: DataFrame, order: str, column: str, path: str) -> None:
    """One file, in order."""
    df.orderBy(order).select(F.col(column).alias("value")).coalesce(1).write.text(path)


def json_lines(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """value: a JSON object for each row with these names for these columns, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"}).alias("value"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(model, n_files, bytes): the files below path, grouped by the folder next below it; contents aren't read."""
    root = path.rstrip("/").split("/")[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    model = F.regexp_extract("path", rf"/{root}/([^/]+)", 1)
    return files.groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
