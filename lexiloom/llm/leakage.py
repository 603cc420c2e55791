"""Test passages inside a training corpus: size-partitioned MinHash containment search, verified exactly.

A passage of ``run`` consecutive words is a set of ``run - shingle + 1`` word shingles.  Every window of ``run`` words
of a test item is indexed under its MinHash, and every window of a document is looked up the same way.  All sets
compared have one size, so a contained passage means equal sets and equal MinHash: no recall is lost, however long the
document is.  (MinHash of whole documents cannot see one shared passage among thousands of shingles; cutting both sides
to one size class is what makes the containment search exact.)  Hits are verified word by word.

The index is broadcast while it has at most ``MAX_BYTES`` bytes, which is counted before anything is collected; beyond
it both sides are joined on the MinHash, after a Bloom filter of the index's has dropped nearly all windows of documents.
Both ways are exact.  Defined results: null and blank texts, and texts of fewer than ``run`` words, hold and leak
nothing; repeated rows count once; a null item text is skipped; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

RUN, SHINGLE, MAX_BYTES = 8, 5, 1 << 26


def window_minhash(flat: np.ndarray, run: int, shingle: int) -> np.ndarray:
    """MinHash of the shingle set of every window of ``run`` words (one per window start)."""
    h = base.run_hashes(flat, shingle)
    w = run - shingle + 1
    k = len(h) - w + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = h[:k].copy()
    for j in range(1, w):
        np.minimum(out, h[j : j + k], out=out)
    return out


def flat_windows(texts: list[str | None], ids: base.WordIds, run: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word ids of all texts, starts of the windows that stay within one text, their MinHashes); owner via searchsorted."""
    parts = [base.token_ids(t, ids) if t else np.empty(0, np.uint64) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    mins = window_minhash(flat, run, shingle)
    inside = owner[: len(mins)] == owner[run - 1 : run - 1 + len(mins)] if len(mins) else np.empty(0, bool)
    starts = np.nonzero(inside)[0]
    return flat, owner, starts, mins[starts]


def contained_items(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, run: int = RUN, shingle: int = SHINGLE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """items: (item_id, text), several texts per item allowed.  Gives (doc_id, item_id, windows, item_windows):
    how many distinct windows of the item the document holds, and how many the item has."""
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)["item_id"]
    ids = base.WordIds()

    passing: list = []  # a broadcast Bloom filter, once there is one
    held: list = []

    def windows(cols: dict) -> dict:
        flat, owner, starts, mins = flat_windows(cols["text"].to_pylist(), ids, run, shingle)
        if passing:
            if not held:
                held.append(base.BloomTest(passing[0].value))
            ok = held[0](mins) if len(mins) else np.empty(0, bool)
            starts, mins = starts[ok], mins[ok]
        grams = base.run_hashes(flat, run)
        return {"key": cols["key"].take(owner[starts]), "minhash": base.signed(mins), "gram": base.signed(grams[starts]), "words": list(flat[starts[:, None] + np.arange(run)].view(np.int64)) if len(starts) else []}

    def as_windows(df: DataFrame, key: str, text: str, key_kind: str) -> DataFrame:
        source = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
        return base.arrow_map(source, windows, f"key {key_kind}, minhash long, gram long, words array<long>")

    index = base.materialize(as_windows(items, "item_id", "text", item_kind).distinct(), "windows")
    totals = index.groupBy("key").agg(F.countDistinct("gram").alias("item_windows")).withColumnRenamed("key", "item_id")
    named = index.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("key").cast("string"))), F.lit(0)).alias("b")).first()
    if named.n * 8 * (run + 2) + named.b > max_bytes:
        passing.append(docs.sparkSession.sparkContext.broadcast(base.bloom(index, "minhash")))
        found = as_windows(docs, id_col, text_col, kind).distinct().withColumnsRenamed({"key": "doc_id"})
        hits = found.join(index.withColumnRenamed("key", "item_id"), ["minhash", "gram", "words"])
        return hits.groupBy("doc_id", "item_id").agg(F.countDistinct("gram").alias("windows")).join(totals, "item_id").select("doc_id", "item_id", "windows", "item_windows")

    got = index.select("minhash", "key", "words").toArrow()
    keys = got.column("minhash").to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    grams = np.asarray(got.column("words").combine_chunks().flatten()).view(np.uint64).reshape(-1, run) if len(keys) else np.empty((0, run), np.uint64)
    names = got.column("key").take(order).to_pylist()
    # The windows and the names of their items: bounded by max_bytes.
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], grams[order], names))

    def search(cols: dict) -> dict:
        keys, grams, names = shared.value
        flat, owner, starts, mins = flat_windows(cols["text"].to_pylist(), ids, run, shingle)
        at = np.searchsorted(keys, mins)
        hit = np.nonzero((at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == mins))[0] if len(keys) and len(mins) else []
        got: dict[tuple[int, object], set[int]] = {}
        for i in hit:
            j, s = at[i], starts[i]
            while j < len(keys) and keys[j] == mins[i]:
                if (grams[j] == flat[s : s + run]).all():
                    got.setdefault((int(owner[s]), names[j]), set()).add(hash(grams[j].tobytes()))
                j += 1
        return {"doc_id": cols["key"].take([o for o, _ in got]) if got else cols["key"].slice(0, 0), "item_id": [n for _, n in got], "windows": [len(v) for v in got.values()]}

    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("key is not null and text is not null")
    hits = base.arrow_map(source, search, f"doc_id {kind}, item_id {item_kind}, windows long")
    return hits.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows")).join(totals, "item_id").select("doc_id", "item_id", "windows", "item_windows")


def evaluation_items(cloze: DataFrame, prompts: DataFrame) -> DataFrame:
    """(item_id, text): the context directly followed by the right choice; the prompt, and separately the reference."""
    right = F.concat("context", F.get("choices", F.col("label")))
    return (
        cloze.select("item_id", right.alias("text"))
        .union(prompts.select("id", "prompt")).union(prompts.select("id", "reference"))
        .where("item_id is not null and text is not null")
    )
