"""What the operators share: table access, lineage cuts in shared storage, column checks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without and gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verbaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a location, for renames and deletes on the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop_scratch(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def cut(df: DataFrame, label: str = "cut", *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch_path"] = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes what cut() wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = None if df is None else df.__dict__.pop("_scratch_path", None)
        if path is not None:
            drop_scratch(df.sparkSession, path)
            _made.remove((df.sparkSession, path))


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or something like it with underscores after it that no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(col):
    """A-Z only, whatever the locale; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
