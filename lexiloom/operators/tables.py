"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is set and all runs on one machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lexiloom-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


@atexit.register
def release() -> None:
    """Delete the tables made so far: at the end of the process, and by long sessions when their results are written."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and the loss of an executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
