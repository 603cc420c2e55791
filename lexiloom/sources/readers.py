"""Source documents from Parquet, JSON lines and text, with filters, offsets and stable ids."""

from __future__ import annotations

import glob
import os
import re
from pathlib import Path
from typing import Any, Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import blank
from ..operators.chat import strip_prefix

SEQ = "seq"
SPREAD_BYTES = 1 << 29
_MARKER = re.compile(r"_SUCCESS$|_committed_|_started_|\..*\.crc$|_metadata$|_common_metadata$")


def expand(path: str) -> list[str]:
    """Files of a path: variables expanded; a directory with all its files, a glob, or one file; sorted.

    A missing file or an empty match raises.  Only Spark's own markers are left out of directories.  Paths with a scheme
    (hdfs://, s3a://) are left to Spark.
    """
    if "://" in path:
        return [path]
    p = os.path.expandvars(os.path.expanduser(path))
    if os.path.isdir(p):
        found = sorted(str(x) for x in Path(p).rglob("*") if x.is_file() and not _MARKER.match(x.name))
    elif any(c in p for c in "*?["):
        found = sorted(x for x in glob.glob(p, recursive=True) if os.path.isfile(x))
    else:
        found = [p] if os.path.isfile(p) else []
    if not found:
        raise FileNotFoundError(path)
    return found


def seen_by_spark(paths: Sequence[str]) -> list[str]:
    """The paths, if Spark reads them all: it passes over names that begin with '_' or '.'."""
    for x in paths:
        if os.path.basename(x).startswith(("_", ".")):
            raise ValueError(f"Spark passes over {x}: rename it")
    return list(paths)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where it is small and in few files: one small file is one task, however heavy the work on its rows.

    Tables beyond SPREAD_BYTES are left to the split size, so no large table is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def read_parquet(spark: SparkSession, paths: Sequence[str], **_: Any) -> DataFrame:
    return spark.read.parquet(*seen_by_spark(paths))


def read_jsonl(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None, **_: Any) -> DataFrame:
    """Blank lines are skipped, gzip is read by its extension, a malformed line raises."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(seen_by_spark(paths))


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A missing file gives no rows, a malformed line is dropped."""
    try:
        files = expand(path)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(files)


def read_text(spark: SparkSession, paths: Sequence[str], doc_sep: str = "blank_line", **_: Any) -> DataFrame:
    """(id = file:ordinal, text): one document a line, a paragraph or a file.  Blank documents are skipped but counted.

    Lines end at any line boundary of Unicode; paragraphs at one empty line, after CRLF has become LF.  Lines and
    paragraphs are read in splits, whatever the size of a file; files with CRLF are read whole for paragraphs.
    """
    if doc_sep == "file":
        raw = _raw_text(spark, paths, None)
        rows = raw.select("name", F.lit(0).cast("long").alias("n"), F.col("value").alias("text"))
    elif doc_sep == "line":
        rows = numbered_pieces(_raw_text(spark, paths, "\n"), lambda v: v.splitlines() or [""])
    elif doc_sep == "blank_line":
        lines = _raw_text(spark, paths, "\n")
        # The files are listed on the driver already; of those with CRLF only the names come there.
        dos = {r.path for r in lines.where(F.col("value").endswith("\r")).select("path").distinct().collect()}
        cut = lambda v: v.replace("\r\n", "\n").split("\n\n")
        parts = [numbered_pieces(_raw_text(spark, paths, None).where(F.col("path").isin(*dos)), cut)] if dos else []
        parts.append(numbered_pieces(_raw_text(spark, paths, "\n\n").where(~F.col("path").isin(*dos)) if dos else _raw_text(spark, paths, "\n\n"), cut))
        rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    else:
        raise ValueError(f"unknown doc_sep {doc_sep!r}")
    return rows.where(~blank("text")).select(F.concat_ws(":", "name", F.col("n").cast("string")).alias("id"), "text")


def _raw_text(spark: SparkSession, paths: Sequence[str], sep: str | None) -> DataFrame:
    """(value, path, name, block).  Files that Spark passes over by their names are opened by the workers."""
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_name", "name"), ("file_block_start", "block"))]
    hidden = [x for x in paths if os.path.basename(x).startswith(("_", "."))]
    plain = [x for x in paths if x not in set(hidden)]
    out = spark.read.text(plain, wholetext=sep is None, lineSep=sep).select("value", *meta) if plain else None
    if hidden:

        def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path in pdf["path"]:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                    parts = [text] if sep is None else text.removesuffix(sep).split(sep)
                    yield pd.DataFrame({"value": parts, "path": path, "name": os.path.basename(path), "block": 0})

        named = spark.createDataFrame([(x,) for x in hidden], "path string").repartition(len(hidden))
        own = named.mapInPandas(opened, "value string, path string, name string, block long")
        out = own if out is None else out.union(own)
    return out


def numbered_pieces(raw: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    """(name, n, text): the pieces of each row's value, numbered through their file.

    A split of a file is read by one task in order, so pieces are numbered inside their split, and the splits' counts,
    a row each, give the offsets.  This reads the files twice and shuffles no text.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple[str, int], int] = {}
        for pdf in batches:
            out = []
            for value, path, name, block in zip(pdf["value"], pdf["path"], pdf["name"], pdf["block"]):
                for piece in cut(value):
                    k = at.get((path, block), 0)
                    at[path, block] = k + 1
                    out.append((path, name, block, k, piece))
            yield pd.DataFrame(out, columns=["path", "name", "block", "k", "text"])

    pieces = raw.select("value", "path", "name", "block").mapInPandas(number, "path string, name string, block long, k long, text string")
    sizes = pieces.groupBy("path", "block").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("path", "block", before.alias("before"))  # one row a split
    return pieces.join(offsets, ["path", "block"]).select("name", (F.col("k") + F.col("before")).alias("n"), "text")


def hub_files(src: Mapping[str, Any]) -> list[str]:
    """Files of a local mirror of a hub dataset: path[/snapshots/revision][/config_name][/data_dir], then ``data_files``
    (a pattern, several, or a map by split), else the files that name the split (default train), else all."""
    if src.get("path") is None:
        raise ValueError("a hub dataset needs the path of its local mirror")
    root = os.path.expandvars(os.path.expanduser(src["path"]))
    if os.path.isfile(root) or "://" in root or any(c in root for c in "*?["):
        return expand(root)
    steps = [os.path.join("snapshots", src["revision"]) if src.get("revision") else None, src.get("config_name"), src.get("data_dir")]
    for step in filter(None, steps):
        root = os.path.join(root, step)
    split, named = src.get("split") or "train", src.get("data_files")
    if isinstance(named, Mapping):
        named = named[split]
    if named is not None:
        return [f for pattern in ([named] if isinstance(named, str) else named) for f in expand(os.path.join(root, pattern))]
    every = expand(root)
    inside = [f for f in every if re.search(rf"(?:^|[^a-z]){re.escape(split)}(?:[^a-z]|$)", os.path.relpath(f, root))]
    return inside or every


def read_hub(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None, **_: Any) -> DataFrame:
    """By extension: Parquet, or JSON lines."""
    return read_jsonl(spark, paths, schema) if all(re.search(r"\.jsonl?(\.gz)?$", p) for p in paths) else read_parquet(spark, paths)


READERS: dict[str, Callable[..., DataFrame]] = {"parquet": read_parquet, "jsonl": read_jsonl, "text": read_text, "hf": read_hub}


def row_filter(spec: Mapping[str, Any] | None, columns: Sequence[str]) -> Column:
    """``{field, equals}`` or ``{field, in}``; an absent field compares as null; nothing passes all; anything else raises."""
    if not spec:
        return F.lit(True)
    known = set(spec) - {"field"}
    if "field" not in spec or known not in ({"equals"}, {"in"}):
        raise ValueError(f"unknown filter {dict(spec)}")
    c = F.col(f"`{spec['field']}`") if spec["field"] in columns else F.lit(None)
    if "equals" in spec:
        return c.eqNullSafe(F.lit(spec["equals"]))
    values = [v for v in spec["in"] if v is not None]
    hit = F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)
    return hit | c.isNull() if None in spec["in"] else hit


def iter_rows(spark: SparkSession, src: Mapping[str, Any], order_col: str | None = None) -> DataFrame:
    """Rows of one source: read, filtered, then offset and limit in order."""
    kind = src.get("type", "parquet")
    if kind not in READERS:
        raise ValueError(f"unknown source type {kind!r}")
    if kind == "hf":
        paths = hub_files(src)
    else:
        paths = [f for p in ([src["path"]] if isinstance(src["path"], str) else src["path"]) for f in expand(p)]
    df = READERS[kind](spark, paths, **{k: src[k] for k in ("doc_sep", "schema") if k in src})
    df = df.where(row_filter(src.get("filter"), df.columns))
    skip, most = int(src.get("skip_docs") or 0), src.get("max_docs")
    order = order_col or src.get("order_field")
    if src.get("shuffle_seed") is not None:
        key = F.xxhash64(F.lit(int(src["shuffle_seed"])), *[F.col(f"`{c}`").cast("string") for c in ([order] if order else df.columns)])
        # Equal keys fall back on the order itself, or on all columns, so the cut is the same on every run.
        df = df.orderBy(key, *([order] if order else [F.col(f"`{c}`").cast("string") for c in df.columns]))
    elif order and (skip or most is not None):
        df = df.orderBy(order)
    if skip:
        df = df.offset(skip)
    return df.limit(int(most)) if most is not None else df


def text_field(df: DataFrame, field: str | Sequence[str]) -> Column:
    """One field as a string, null as ''; of several the non-blank string ones, joined by a blank line."""
    kinds = dict(df.dtypes)
    if isinstance(field, str):
        return F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")) if field in kinds else F.lit("")
    parts = [F.col(f"`{f}`") for f in field if kinds.get(f) == "string"]
    return F.array_join(F.filter(F.array(*parts), lambda x: ~blank(x)), "\n\n") if parts else F.lit("")


def source_documents(df: DataFrame, src: Mapping[str, Any], order_col: str) -> DataFrame:
    """(text, source, source_id, seq): rows with text; the id is a field, or the row's position in order.

    Positions count rows whose text is empty, and start after those skipped.
    """
    text = strip_prefix(text_field(df, src.get("text_field", "text")), src.get("strip_prefixes") or ())
    named = src.get("id_field") or ("id" if "id" in df.columns else None)
    if named:
        sid = F.coalesce(F.col(f"`{named}`").cast("string"), F.lit("None")) if named in df.columns else F.lit("None")
        rows = df.select(text.alias("text"), sid.alias("source_id"), F.col(order_col).alias(SEQ))
    else:
        from ..operators.split import rank_within

        at = rank_within(df.withColumn("_all", F.lit(0)), "_all", order_col)
        sid = (F.col("rank") - 1 + int(src.get("skip_docs") or 0)).cast("string")
        rows = at.select(text.alias("text"), sid.alias("source_id"), F.col(order_col).alias(SEQ))
    return rows.where("text <> ''").select("text", F.lit(src["name"]).alias("source"), "source_id", SEQ)


def each_source(sources: Sequence[Mapping[str, Any]], load: Callable[[Mapping[str, Any]], DataFrame], log: Callable[[str], None] = print) -> Iterator[tuple[int, Mapping[str, Any], DataFrame]]:
    """(ordinal, source, rows) of the enabled sources.  One that can't be read is reported and left out unless required."""
    for i, src in enumerate(s for s in sources if s.get("enabled", True)):
        try:
            df = load(src)
            df.limit(1).count()  # Spark reads lazily: a broken source shows only here
        except Exception as e:
            if src.get("required"):
                raise
            log(f"source {src['name']} left out: {type(e).__name__}: {str(e)[:200]}")
            continue
        yield i, src, df


def union_sources(spark: SparkSession, sources: Sequence[Mapping[str, Any]], load: Callable[[Mapping[str, Any]], DataFrame], log: Callable[[str], None] = print) -> DataFrame:
    """All sources in order, with their ordinal."""
    out = None
    for i, _, df in each_source(validated(sources), load, log):
        df = df.withColumn("source_ordinal", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source could be read")
    return out


def validated(sources: Sequence[Mapping[str, Any]]) -> list[Mapping[str, Any]]:
    live = [s for s in sources if s.get("enabled", True)]
    names = [s["name"] for s in live]
    if not live:
        raise ValueError("no source is enabled")
    if len(set(names)) < len(names):
        raise ValueError("two sources have one name")
    return live


def read_shards(spark: SparkSession, root: str, category: str | None = None, split: str | None = None) -> DataFrame:
    """Shards written by ``write_corpus``; category and split prune whole directories.  A missing root gives no rows."""
    if "://" not in root and not os.path.isdir(root):
        return spark.createDataFrame([], "text string, category string, split string")
    df = spark.read.parquet(root)
    for c, v in (("category", category), ("split", split)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def available_categories(spark: SparkSession, root: str) -> list[str]:
    """From the directories alone."""
    return sorted(r[0] for r in read_shards(spark, root).select("category").distinct().collect())


def file_order(file_col: str, pos_col: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(file_col))), F.col(file_col), F.col(pos_col)]


def shuffled_files(df: DataFrame, file_col: str, pos_col: str, seed: int) -> DataFrame:
    """Documents file by file, files in seeded order."""
    return df.orderBy(*file_order(file_col, pos_col, seed))


def numbered(df: DataFrame, order_col: str) -> DataFrame:
    """df with a dense 0-based position; for small tables."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(order_col)) - 1)
