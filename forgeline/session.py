"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def build_session(app: str = "forgeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work in Python, over at least as many partitions as there are cores.

    A file of a single row group is one partition; only such a table, with fewer partitions than cores, is dealt out."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where that is unset, a session within one machine (a ``local`` master) gets a folder of its own, as its only
    executor is this process; on a cluster it is an error, as no folder of one machine is seen by the others.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-forgeline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context is gone already
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/forgeline-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return _read(spark, df.schema, [path])


def _read(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    out = spark.read.schema(schema).parquet(*paths)
    out.written_to = paths
    return out


def read_together(tables: list[DataFrame]) -> DataFrame:
    """All rows of materialized tables of one schema as a single scan, however many they are."""
    return _read(tables[0].sparkSession, tables[0].schema, [p for t in tables for p in t.written_to])


def materialize_observed(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and named aggregates of the rows, taken in the same job."""
    seen = Observation()
    out = materialize(df.observe(seen, *measures), name)
    return out, seen.get


def materialize_counted(df: DataFrame, name: str, which: Column | None = None) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows (of those for which ``which`` holds), taken in the same job."""
    out, seen = materialize_observed(df, name, F.count_if(F.lit(True) if which is None else which).alias("n"))
    return out, int(seen["n"])
