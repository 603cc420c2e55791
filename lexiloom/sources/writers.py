"""Sinks: sharded corpora, JSON lines, stats, manifests and reports, guarded against overwriting."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATS = "stats.json"


def _hadoop(path: str):
    """(file system, path) of a URI in the running session; None for local paths."""
    if "://" not in path:
        return None
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def names_in(path: str) -> list[str]:
    """Names inside a folder, none if it isn't there; local paths and those of any file system Spark knows."""
    remote = _hadoop(path)
    if remote is None:
        return sorted(os.listdir(path)) if os.path.isdir(path) else []
    system, target = remote
    return sorted(x.getPath().getName() for x in system.listStatus(target)) if system.exists(target) else []


def prepare_output(path: str, overwrite: bool = False) -> None:
    """A folder with content is refused, unless it may be overwritten and is ours, which its stats file shows."""
    names = names_in(path)
    if not names:
        return
    if not overwrite:
        raise FileExistsError(f"{path} is not empty")
    if STATS not in names:
        raise FileExistsError(f"{path} has no {STATS}: not written by this pipeline")


def write_corpus(df: DataFrame, path: str, rows_per_file: int = 200_000, fmt: str = "parquet", category_col: str = "category", split_col: str = "split_name") -> None:
    """One folder per category and split, at most rows_per_file rows a file; fmt: parquet, or json (gzip)."""
    out = df.withColumnRenamed(split_col, "split").withColumnRenamed(category_col, "category")
    writer = out.write.mode("overwrite").partitionBy("category", "split").option("maxRecordsPerFile", rows_per_file)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "json":
        writer.option("compression", "gzip").json(path)
    else:
        raise ValueError(fmt)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> int:
    """Rows written, counted while they are."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def append_ratings(ratings: DataFrame, path: str) -> None:
    """Append well-formed ratings only, those without a time stamped with the present one in UTC (to the second)."""
    from ..operators.ratings import valid

    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    stamp = F.coalesce(F.col("ts").cast("string"), F.lit(now)) if "ts" in ratings.columns else F.lit(now)
    ratings.where(valid()).withColumn("ts", stamp).write.mode("append").json(path)


def save_json(path: str, data: Any) -> None:
    text = json.dumps(data, ensure_ascii=False, indent=2, default=str)
    remote = _hadoop(path)
    if remote is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    out = remote[0].create(remote[1], True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def run_stats(outcomes: DataFrame, sizes: DataFrame, path: str) -> dict[str, Any]:
    """Counts per source and outcome, documents and characters per category and split; both are small by nature."""
    stats: dict[str, Any] = {"sources": {}, "categories": {}}
    for r in outcomes.collect():
        stats["sources"].setdefault(r["source"], {})[r["outcome"]] = r["n"]
    for r in sizes.collect():
        stats["categories"].setdefault(r["category"], {})[r["split_name"]] = {"docs": r["docs"], "chars": r["chars"]}
    save_json(os.path.join(path, STATS), stats)
    return stats


def run_metadata(config: dict[str, Any], path: str) -> dict[str, Any]:
    """Resolved configuration, revision, versions and command line of a run."""

    def git(*args: str) -> str:
        return subprocess.run(["git", *args], capture_output=True, text=True).stdout.strip()

    data = {
        "config": config, "at": datetime.now(timezone.utc).isoformat(), "argv": sys.argv,
        "git": {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))},
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
    }
    save_json(os.path.join(path, "run.json"), data)
    return data


def save_packed(blocks: DataFrame, path: str, manifest: dict[str, Any], evals: dict[str, DataFrame] | None = None) -> None:
    """Packed blocks with a manifest, which is written last and so marks a complete table."""
    blocks.write.mode("overwrite").parquet(os.path.join(path, "train"))
    for name, table in (evals or {}).items():
        table.write.mode("overwrite").parquet(os.path.join(path, f"eval_{name}"))
    save_json(os.path.join(path, "manifest.json"), manifest)


def load_packed(spark, path: str, build=None, name: str = "train") -> DataFrame:
    """A packed table, train or eval_<set>; built first if there is no manifest and a builder is given."""
    if "manifest.json" not in names_in(path):
        if build is None:
            raise FileNotFoundError(os.path.join(path, "manifest.json"))
        build()
    return spark.read.parquet(os.path.join(path, name))


def eval_tables(path: str) -> list[str]:
    return [x for x in names_in(path) if x.startswith("eval_")]
