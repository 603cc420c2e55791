"""One global ranking from pairwise votes: Iterative Luce spectral ranking.

Votes are counted per ordered pair where they lie, so only pair totals are shuffled, however uneven the pairs are.  From
the current strengths each win of i over j gives the chain j -> i the rate wins / (strength_i + strength_j); the
stationary distribution of the chain is the next estimate, and its fixed point is the exact maximum-likelihood
(Bradley-Terry-Luce) strength.  Ties count half for each side.

Up to ``DENSE_ITEMS`` items the chain is solved exactly on the driver (the pair totals are then at most their square,
which bounds what is collected); beyond, where no dense chain fits, Newton steps on the distributed pair totals find the
same maximum.

Defined results: each strongly connected component of the comparisons (who beat whom) gets its exact maximum-likelihood
strengths.  Between components, and for items alone in one, no maximum exists: only there a fit decides in which every item
has ``PRIOR`` pseudo-wins both ways against one hub item, which is no result; it gives the components their mean.  Both
hold at any number of items.  Equal strengths rank by name; an empty registry gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

DENSE_ITEMS, PRIOR, TOLERANCE, ROUNDS = 500, 0.05, 1e-10, 2000


def clean(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))


def valid_votes(ratings: DataFrame, registry: DataFrame) -> DataFrame:
    """(rating_id, a, b, winner): the latest row of each rating_id, where it is a vote between two registered models.

    Validity is judged after the latest row is chosen: a correction that is no vote takes its earlier vote away.
    """
    rows = ratings.select("rating_id", "received_at", clean("mode").alias("mode"), clean("model_a").alias("a"), clean("model_b").alias("b"), clean("winner").alias("winner"))
    last = base.latest(rows.where("rating_id is not null"), "rating_id", "received_at", ["mode", "a", "b", "winner"])
    names = registry.select(clean("model").alias("m")).distinct()
    votes = last.where("mode = 'compare' and winner in ('a', 'b', 'tie', 'both_bad') and a <> b")
    return votes.join(names.withColumnRenamed("m", "a"), "a", "left_semi").join(names.withColumnRenamed("m", "b"), "b", "left_semi").select("rating_id", "a", "b", "winner")


def pair_wins(votes: DataFrame) -> DataFrame:
    """(winner, loser, wins), ties as half a win for each."""
    a_share = F.when(F.col("winner") == "a", 1.0).when(F.col("winner") == "b", 0.0).otherwise(0.5)
    totals = votes.groupBy("a", "b").agg(F.sum(a_share).alias("wa"), F.sum(1.0 - a_share).alias("wb"))
    both = totals.select(F.explode(F.array(F.struct(F.col("a").alias("winner"), F.col("b").alias("loser"), F.col("wa").alias("w")), F.struct(F.col("b").alias("winner"), F.col("a").alias("loser"), F.col("wb").alias("w")))).alias("x")).select("x.*")
    return both.groupBy("winner", "loser").agg(F.sum("w").alias("wins")).where("wins > 0")


def components(wins: np.ndarray) -> np.ndarray:
    """Number of the strongly connected component of each item."""
    reach = (wins > 0) | np.eye(len(wins), dtype=bool)
    for _ in range(int(np.ceil(np.log2(max(len(wins), 2)))) + 1):
        reach = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
    return np.argmax(reach & reach.T, axis=1)  # the first item that reaches it and is reached


def settled_strengths(wins: np.ndarray) -> np.ndarray:
    """Strengths of one strongly connected component (mean 1): rates, stationary distribution, and again."""
    size = len(wins)
    p = np.full(size, 1.0)
    for _ in range(ROUNDS):
        rate = wins.T / (p[:, None] + p[None, :])  # rate[j, i]: from loser j to winner i
        np.fill_diagonal(rate, 0)
        balance = rate - np.diag(rate.sum(axis=1))
        system = np.vstack([balance.T[:-1], np.ones(size)])
        new = np.linalg.solve(system, np.r_[np.zeros(size - 1), size])
        new = np.maximum(new, 1e-300)
        if np.abs(np.log(new) - np.log(p)).max() < TOLERANCE:
            return new
        p = new
    raise RuntimeError("strengths did not settle")


def _means(theta: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Mean of each item's component."""
    n = np.bincount(group, minlength=len(theta))
    return (np.bincount(group, theta, len(theta)) / np.maximum(n, 1))[group]


def ilsr(wins: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Strengths (mean 1) from wins[i, j] = times i beat j."""
    n = len(wins)
    if n < 2:
        return np.ones(n)
    group = components(wins)
    if (group == group[0]).all():
        return settled_strengths(wins)
    padded = np.pad(wins, ((0, 1), (0, 1)), constant_values=prior)  # the last item is the hub
    padded[-1, -1] = 0
    rough = np.log(settled_strengths(padded)[:n])
    theta = rough.copy()
    for g in np.unique(group):
        own = np.nonzero(group == g)[0]
        if len(own) > 1:
            theta[own] = np.log(settled_strengths(wins[np.ix_(own, own)]))
    theta += _means(rough, group) - _means(theta, group)
    p = np.exp(theta - theta.max())
    return p / p.mean()


def _relaxed(edges: DataFrame, start: str, end: str, value: np.ndarray, open_: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """The greatest value that reaches each open item along the edges between open items (of one ``within``).  Each
    round gives the driver the items whose value has grown."""
    while True:
        before = value.copy()

        def spread(batches, before: np.ndarray = before):
            import pyarrow as pa

            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            parts = [(u[k], v[k]) for u, v in parts for k in [open_[u] & open_[v] & (True if within is None else within[u] == within[v])]]
            now, last = before.copy(), None
            while parts and (last is None or (now != last).any()):  # as far as this task's pairs lead
                last = now.copy()
                for u, v in parts:
                    np.maximum.at(now, v, now[u])
            grown = np.nonzero(now != before)[0]
            yield pa.RecordBatch.from_arrays([pa.array(grown.astype(np.int32)), pa.array(now[grown].astype(np.int32))], names=["k", "x"])

        got = edges.select(start, end).mapInArrow(spread, "k int, x int").groupBy("k").agg(F.max("x").alias("x")).collect()
        if not got:
            return value
        value = value.copy()
        value[[r.k for r in got]] = [r.x for r in got]


def _components(edges: DataFrame, n: int) -> np.ndarray:
    """Number of the strongly connected component of each item, by colours: the greatest item that reaches an item is its
    colour, and those that reach their colour's item back are its component.  Numbers per item are all the driver holds."""
    group, open_ = np.arange(n), np.ones(n, dtype=bool)
    while open_.any():
        colour = _relaxed(edges, "i", "j", np.arange(n), open_)
        roots = open_ & (colour == np.arange(n))
        back = _relaxed(edges, "j", "i", roots.astype(int), open_, colour).astype(bool) & open_
        group[back] = colour[back]
        open_ &= ~back
    return group


def _spread(wins: DataFrame, names: list[str], tolerance: float = 1e-8, rounds: int = 200) -> np.ndarray:
    """Strengths (mean 1) of the named items on distributed pair totals: the same as ``ilsr``.

    The driver holds numbers per item only.  Every round is a Newton step of the log likelihood, solved by conjugate
    gradients whose products are summed over the pairs where they lie, and damped while it is long, so that it always
    ends at the one maximum.  Raises if ``tolerance`` (of the logarithms) isn't reached.
    """
    n = len(names)
    if n < 2:
        return np.ones(n)
    places = wins.sparkSession.createDataFrame(list(zip(names, range(n))), "model string, k int")
    edges = base.materialize(
        wins.join(places.toDF("winner", "i"), "winner").join(places.toDF("loser", "j"), "loser").where("wins > 0 and i <> j").select("i", "j", F.col("wins").cast("double").alias("w")), "edges"
    )
    group = _components(edges, n)
    if (group == group[0]).all():
        theta = _newton(edges, n, None, np.zeros(n), tolerance, rounds)
    else:
        rough = _newton(edges, n, "hub", np.zeros(n), tolerance, rounds)
        theta = _newton(edges, n, group, rough, tolerance, rounds)
        theta += _means(rough, group) - _means(theta, group)
    p = np.exp(theta - theta.max())
    return p / p.mean()


def _newton(edges: DataFrame, n: int, mode: str | np.ndarray | None, theta: np.ndarray, tolerance: float, rounds: int) -> np.ndarray:
    """Logarithms of the strengths.  mode: "hub" adds the hub item; an array keeps the pairs inside its groups only."""
    hub = isinstance(mode, str)
    group = None if hub else mode
    size = n + hub
    k = np.arange(n)
    own = (np.r_[k, np.full(n, n)], np.r_[np.full(n, n), k], np.full(2 * n, PRIOR)) if hub else None

    def sums(f) -> np.ndarray:
        """Two numbers per item, summed over the pairs: f(i, j, w) gives one column for the winner and one for the loser each."""

        def fold(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.array([np.bincount(i, a, size) + np.bincount(j, b, size) for a, b in f(i, j, w)])

        def run(cols: dict) -> dict:
            i, j, w = (cols[c].to_numpy() for c in ("i", "j", "w"))
            if group is not None:
                inside = group[i] == group[j]
                i, j, w = i[inside], j[inside], w[inside]
            got = fold(i, j, w)
            at = np.nonzero(got.any(axis=0))[0]
            return {"k": at.astype(np.int32), "a": got[0, at], "b": got[1, at]}

        out = fold(*own) if hub else np.zeros((2, size))
        for r in base.arrow_map(edges, run, "k int, a double, b double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
            out[:, r.k] += (r.a, r.b)
        return out

    def lost(t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Probability that j beats i."""
        return 0.5 * (1 + np.tanh((t[j] - t[i]) / 2))

    theta = np.r_[theta, np.zeros(size - n)]
    for _ in range(rounds):

        def slope(i, j, w, t=theta):
            q = lost(t, i, j)
            m = w * q * (1 - q)
            return (w * q, -w * q), (m, m)

        def bend(x: np.ndarray) -> np.ndarray:
            def f(i, j, w, t=theta):
                q = lost(t, i, j)
                y = w * q * (1 - q) * (x[i] - x[j])
                return (y, -y), (0 * y, 0 * y)

            return sums(f)[0]

        gradient, diagonal = sums(slope)
        diagonal = np.where(diagonal > 0, diagonal, 1.0)  # items alone in their component
        step, rest = np.zeros(size), gradient
        z = rest / diagonal
        way, power = z, rest @ z
        goal = 1e-8 * power
        for _ in range(4 * size):
            if power <= goal or power < 1e-26:
                break
            y = bend(way)
            a = power / (way @ y)
            step, rest = step + a * way, rest - a * y
            z = rest / diagonal
            way, power = z + way * ((rest @ z) / power), rest @ z
        if group is not None:
            step = step - _means(step, group)
        length = np.ptp(step)
        theta = theta + step * (np.log1p(length) / length if length > 1 else 1.0)
        if group is None:
            theta -= theta[:n].mean()
        if length < tolerance:
            return theta[:n]
    raise RuntimeError("strengths did not settle")


def ranking(ratings: DataFrame, registry: DataFrame, dense_items: int = DENSE_ITEMS) -> DataFrame:
    """(model, rank_no, strength, votes): one row per registered model, 1 the strongest.  The registry fits the driver."""
    spark = ratings.sparkSession
    votes = valid_votes(ratings, registry)
    wins = base.materialize(pair_wins(votes), "wins")
    items = registry.where("model is not null").select(F.col("model").alias("name"), clean("model").alias("model")).groupBy("model").agg(F.min("name").alias("name"))
    shown = {r.model: r.name for r in items.collect()}
    names = sorted(shown)
    if len(names) <= dense_items:
        at = {m: i for i, m in enumerate(names)}
        table = np.zeros((len(names), len(names)))
        for r in wins.collect():
            table[at[r.winner], at[r.loser]] = r.wins
        p = ilsr(table)
    else:
        p = _spread(wins, names)
    order = sorted(range(len(names)), key=lambda i: (-p[i], names[i]))
    rows = [(names[i], shown[names[i]], float(p[i]), k) for k, i in enumerate(order, 1)]
    strength = spark.createDataFrame(rows, "key string, model string, strength double, rank_no int")
    counts = wins.select(F.explode(F.array("winner", "loser")).alias("key"), "wins").groupBy("key").agg(F.sum("wins").alias("votes"))
    return strength.join(counts, "key", "left").select("model", "strength", F.coalesce("votes", F.lit(0.0)).alias("votes"), "rank_no")
