"""Shared pieces of the training-data operators: word rules, hashing, bounded Bloom filters, cut points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import materialize  # noqa: F401  (for all operators of this subpackage)

NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
SCAN_BATCH = 2000
BLOOM_BITS = 1 << 27  # 16 MB at most
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per key: the one with the latest ``at``; ties fall to the largest values, so the result is stable.

    Only ``columns`` are carried, hence callers reduce texts to results first and never shuffle the texts.
    """
    best = F.max(F.struct(F.col(at).alias("_at"), *[F.col(c) for c in columns])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])


def words(text: str | None) -> list[str]:
    """NFC, lower case, split at white space, keep letters, marks and numbers, drop empties."""
    if not text:
        return []
    return [w for t in unicodedata.normalize("NFC", text).lower().split() if (w := NOT_WORD.sub("", t))]


class WordIds(dict):
    """Raw token -> 64-bit id of its word (0: no word left).  Bounded: it starts afresh at ``limit`` entries."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = NOT_WORD.sub("", token)
        got = self[token] = stable_hash(word) if word else 0
        return got


def stable_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) or 1


def token_ids(text: str, ids: WordIds) -> np.ndarray:
    """Ids of the words of a text, by the rule of ``words``."""
    got = np.fromiter((ids[t] for t in unicodedata.normalize("NFC", text).lower().split()), dtype=np.uint64)
    return got[got != 0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive ids (order matters); fewer than n ids give none."""
    k = len(ids) - n + 1
    if k <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(k, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + k]
            h ^= h >> np.uint64(29)
    return mix(h)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over a function from a record batch's columns (dict of lists) to columns (dict of lists or arrays)."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    if not isinstance(kind, StructType):
        raise TypeError(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), SCAN_BATCH):
                part = batch.slice(at, SCAN_BATCH)
                out = fn({name: part.column(i) for i, name in enumerate(part.schema.names)})
                if out is not None:
                    cols = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for f, c in ((f, out[f.name]) for f in arrow)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def bloom(df: DataFrame, column: str, most_bits: int = BLOOM_BITS, tasks: int = 32) -> bytes:
    """Bloom filter (2 probes, 8 bits a key) of a 64-bit column of a written table, of at most ``most_bits``.

    A full filter passes everything, so it only ever saves shuffling and never drops a row.
    """
    keys = df.select(F.col(column).cast("long").alias("k")).where("k is not null")
    bits = 1 << 10
    wanted = min(most_bits, 8 * keys.count())
    while bits < wanted:
        bits <<= 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, dtype=bool)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p in _probes(h, bits):
                flags[p] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    # Only the keys are moved, so the scan before stays in its own tasks.
    for row in keys.repartition(min(tasks, 1 + bits // (1 << 20))).mapInArrow(build, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, dtype=np.uint8)
    return total.tobytes()


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(h)
    return (m % np.uint64(bits)).astype(np.int64), ((m >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)


class BloomTest:
    """Worker side of ``bloom``: ask with an array of 64-bit keys.  The filter stays packed."""

    def __init__(self, raw: bytes):
        self.packed = np.frombuffer(raw, dtype=np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        a, b = (self.packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 for p in _probes(h, 8 * len(self.packed)))
        return (a & b).astype(bool)


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """rows joined with the one row of their group in a written table, where ``size`` is the group's number of rows.

    Groups that hold more than 1 / ``share`` of the rows are fewer than ``share``, so they are broadcast; the rest, in
    which no key is hot, is shuffled.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = groups.where(F.col(size) * share > total)
    if not hot.limit(1).count():
        return rows.join(groups, key)
    cold = groups.where(F.col(size) * share <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
