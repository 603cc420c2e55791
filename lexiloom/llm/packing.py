"""Items packed into containers of one capacity, every window of containers at the target mixture of sources.

Each source is a queue in a stable pseudo-random order.  Deficit round-robin gives every queue that still has items, in
every window, its share of the window's tokens; what it cannot use is carried to the next window, and the share of an
emptied queue passes to the others.  Its rounds have a closed form: tokens of a queue per unit of weight are a clock that
all queues share, an item is sent when the clock reaches (tokens up to and including it) / weight, and the tokens that all
queues have sent by then, a sum of one bounded line per source, give its window.  So windows come from prefix sums,
computed in two phases (totals of hash ranges, then sums inside a range): no source, however large, is in one task.
Within a window, whose size is bounded, best fit decreasing fills the containers.

Only items larger than the capacity are split, into full containers and a rest.  Defined results: items without tokens
(null or empty text) are left out; a null source is the queue 'unknown'; repeated ids count once; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

CAPACITY, WINDOW, RANGES = 2048, 128, 4096
MOST_SOURCES = 100_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; items in falling size go where the least room is left that still holds them."""
    rooms: list[tuple[int, int]] = []
    out, n = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            room, box = capacity, n
            n += 1
        else:
            room, box = rooms.pop(at)
        out[i] = box
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], box))
    return out


def source_totals(items: DataFrame, weights: dict[str, float] | None) -> dict[str, tuple[float, float]]:
    """source -> (weight, tokens): the given weights of present sources, else each source's own tokens.  A row a source."""
    rows = items.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("more sources than queues can be kept for")
    if weights is None:
        return {r.source: (r.t, r.t) for r in rows}
    return {r.source: (float(weights[r.source]), r.t) for r in rows if weights.get(r.source, 0) > 0}


def sent_by(totals: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the line that says how many tokens all queues have sent at each time of the clock."""
    ends = sorted((t / w, w) for w, t in totals.values())
    clock, sent, rate, at = [0.0], [0.0], sum(w for _, w in ends), 0.0
    for end, w in ends:
        sent.append(sent[-1] + rate * (end - at))
        clock.append(end)
        rate, at = rate - w, end
    return np.array(clock), np.array(sent)


def pack(items: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """items (item_id, source, n_tokens) -> (item_id, piece_no, source, start_token, n_tokens, window_no, container_no).

    container_no counts within the window.  Sources without weight are left out when weights are given.
    """
    items = items.where("n_tokens > 0").select("item_id", F.coalesce("source", F.lit("unknown")).alias("source"), "n_tokens")
    totals = source_totals(items, weights)
    clock, sent = sent_by(totals)
    if weights is not None:
        items = items.where(F.col("source").isin(*totals) if totals else F.lit(False))
    cut = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))))
    pieces = cut.select(
        "item_id", "source", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("start_token"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no").cast("long") * capacity).alias("n_tokens"),
        F.xxhash64("item_id").alias("h"),
    ).withColumn("range", F.shiftrightunsigned(F.col("h"), 52).cast("int"))
    by_range = pieces.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select("source", "range", F.coalesce(F.sum("t").over(running), F.lit(0)).alias("before"))  # at most RANGES rows a source
    inside = Window.partitionBy("source", "range").orderBy("h", "item_id", "piece_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("own", F.sum("n_tokens").over(inside)).join(offsets, ["source", "range"])
    per_weight = {name: w for name, (w, _) in totals.items()}

    def window_of(cols: dict) -> dict:
        w = np.array([per_weight[x] for x in cols["source"].to_pylist()], dtype=float)
        tokens = cols["before"].to_numpy().astype(float) + cols["own"].to_numpy()
        out = np.interp(tokens / np.maximum(w, 1e-300), clock, sent) / (window * capacity)
        return {c: cols[c] for c in cols if c not in ("before", "own")} | {"window_no": np.maximum(0, np.ceil(out - 1e-9) - 1).astype(np.int64)}

    kind = dict(items.dtypes)["item_id"]
    sized = placed.select("item_id", "piece_no", "source", "start_token", "n_tokens", "h", F.col("before").cast("long"), F.col("own").cast("long"))
    windowed = base.arrow_map(sized, window_of, f"item_id {kind}, piece_no int, source string, start_token long, n_tokens long, h long, window_no long")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "item_id", "piece_no"])
        pdf["container_no"] = best_fit_decreasing(pdf["n_tokens"].tolist(), capacity)
        return pdf[["item_id", "piece_no", "source", "start_token", "n_tokens", "window_no", "container_no"]]

    return windowed.groupBy("window_no").applyInPandas(fill, f"item_id {kind}, piece_no int, source string, start_token long, n_tokens long, window_no long, container_no int")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(window_no, containers, n_tokens, fill): used part of each window's containers."""
    per = packed.groupBy("window_no").agg(F.count_distinct("container_no").alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.withColumn("fill", F.round(F.col("n_tokens") / (F.col("containers") * capacity), 6))
