"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "barrow", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, adaptive execution, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and columns of a stored table, rows with equal keys once (the first in file order); null keys equal each other.

    Only keys and row positions are shuffled, folded map-side; the repeated keys are written as a table, so their joining is
    a broadcast if that table is small and a sort-merge join if it is not. Where keys seldom repeat, no column moves.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = table(spark, sf_dir, name).select(*keys, *columns, at.alias("_at"))
    again = rows.groupBy(*keys).agg(F.min("_at").alias("_kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = cut(again.withColumnsRenamed({k: f"_{k}" for k in keys}))
    repeated = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) & (F.col("_at") != F.col("_kept"))
    return rows.join(again, repeated, "left_anti").drop("_at")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset in local mode.

    A cluster without the setting is an error: a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="barrow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_cuts: list[str] = []


def discard(spark: SparkSession) -> int:
    """Delete the tables that cut() has written in this process, once nothing reads them any more; returns their number."""
    done = 0
    _cached.clear()
    while _cuts:
        path = spark._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


_cached: dict[str, tuple[float, DataFrame]] = {}


def cached(name: str, build: Callable[[], DataFrame], seconds: float = 3600.0) -> DataFrame:
    """MAT-24, STM-04: a named table that is built, written and read back, and built anew once it is older than `seconds`."""
    held = _cached.get(name)
    if held is None or time.monotonic() - held[0] > seconds:
        held = _cached[name] = time.monotonic(), cut(build())
    return held[1]


def cut(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Lineage ends here, the data survives the loss of executors, and the result is compressed and columnar,
    unlike the serialised rows of checkpoint(). The table stays until discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barrow/{uuid.uuid4().hex}"
    _cuts.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
