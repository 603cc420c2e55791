"""Near-duplicate texts by SetSketch registers, banded, estimated jointly, then verified exactly.

A text is the set of its runs of ``shingle`` consecutive words.  Each of the ``REGISTERS`` registers keeps the
truncated, exponentially spaced minimum of the set under its own hash, so sketches merge by maximum and agree in a
register with a probability that follows the similarity.  Bands of ``ROWS`` registers give candidate pairs, the joint
likelihood of the register order gives each pair's similarity, and what passes is verified on the exact sets.

Defined results: null and blank texts, and texts with fewer than ``shingle`` words, have no set and are in no pair; in
groups they form a class with the texts of the same words, and null and blank ones one of their own.
Rows repeated under one id count once, the latest delivery (``order_col``) stands.  Texts with equal sets form one
class, told by 128 bits of hash, and are compared once, through the class's smallest id.  Empty tables give empty results.
Extra columns are ignored.  No bucket is capped: members of buckets beyond ``hot_bucket`` go through an exact
prefix-filter join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

BASE, RATE, LIMIT = 1.001, 20.0, 65_534
BLOCK = 1000


@dataclass(frozen=True)
class NearDupConfig:
    """threshold: least shared part of the union.  margin: how far the estimate may fall short of it (over 4 standard
    errors) and still be verified."""

    shingle: int = 5
    threshold: float = 0.8
    rows: int = 2
    bands: int = 32
    margin: float = 0.28
    hot_bucket: int = 200

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def shingle_sets(texts: list[str | None], n: int, ids: base.WordIds) -> list[np.ndarray]:
    """Sorted distinct run hashes of each text."""
    return [np.unique(base.run_hashes(base.token_ids(t, ids), n)) if t else np.empty(0, np.uint64) for t in texts]


def setsketch(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """Registers of the non-empty sets, one row each (uint16).

    Register j keeps max over elements of floor(1 - log_b(x)), x ~ Exp(a): the smallest x decides, so the minimum of
    the uniform hashes is taken first and transformed once.
    """
    out = np.zeros((len(sets), registers), dtype=np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    flat = np.concatenate([sets[i] for i in filled])
    starts = np.cumsum([0] + [len(sets[i]) for i in filled[:-1]])
    least = np.empty((len(filled), registers), dtype=np.uint64)
    odd = base.mix(np.arange(1, registers + 1, dtype=np.uint64)) | np.uint64(1)
    plus = base.mix(np.arange(10_001, 10_001 + registers, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for j in range(registers):
            least[:, j] = np.minimum.reduceat(flat * odd[j] + plus[j], starts)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    k = np.floor(1 - np.log(x) / np.log(BASE))
    out[filled] = np.clip(k, 0, LIMIT + 1).astype(np.uint16)
    return out


def joint_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches from the counts of registers above, below and equal.

    With u, v the sizes' shares, P(above) = p(u - v J) and P(below) = p(v - u J), p(x) = -log_b(1 - x (b-1)/b).
    The log likelihood is concave in J; it is maximised by ternary search, all pairs at once.
    """
    above, below = (a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float)
    equal = a.shape[1] - above - below
    u = na / (na + nb)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        pa_, pb_ = p(u - v * j), p(v - u * j)
        return above * np.log(pa_ + 1e-12) + below * np.log(pb_ + 1e-12) + equal * np.log(np.clip(1 - pa_ - pb_, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        m1, m2 = low + (high - low) / 3, high - (high - low) / 3
        worse = score(m1) < score(m2)
        low, high = np.where(worse, m1, low), np.where(worse, high, m2)
    return (low + high) / 2


def sketches(df: DataFrame, id_col: str, text_col: str, order_col: str, cfg: NearDupConfig) -> DataFrame:
    """One row per id: key of its set, size and registers.  Texts without a set have size 0, no registers and the key of
    their words in order, or no key without words."""
    n, registers = cfg.shingle, cfg.registers
    ids = base.WordIds()

    def run(cols: dict[str, pa.Array]) -> dict | None:
        texts = cols["text"].to_pylist()
        sets = shingle_sets(texts, n, ids)
        regs = setsketch(sets, registers)
        return {
            "id": cols["id"], "at": cols["at"],
            "set_key": pa.array([_set_key(s) if len(s) else _short_key(t, ids) for s, t in zip(sets, texts)], pa.binary()),
            "size": pa.array([len(s) for s in sets], pa.int32()),
            "registers": pa.array([r.tobytes() if len(s) else b"" for s, r in zip(sets, regs)], pa.binary()),
        }

    kinds = dict(df.dtypes)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(order_col).alias("at")).where("id is not null")
    rows = base.arrow_map(source, run, f"id {kinds[id_col]}, at {kinds[order_col]}, set_key binary, size int, registers binary")
    return base.latest(base.materialize(rows, "sketch"), "id", "at", ["set_key", "size", "registers"])


def _set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _short_key(text: str | None, ids: base.WordIds) -> bytes | None:
    got = base.token_ids(text, ids) if text else ()
    return _set_key(got) if len(got) else None


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, order_col: str, cfg: NearDupConfig = NearDupConfig()) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id, n members of the class) and (links: class_a < class_b, similarity) between classes of equal sets."""
    return linked_classes(base.materialize(sketches(df, id_col, text_col, order_col, cfg), "one"), df, id_col, text_col, cfg)


def short_classes(every: DataFrame) -> DataFrame:
    """(id, class_id, n) of the ids without a set: equal words in order make a class, texts without words stand alone."""
    short = every.where("size = 0").select("id", "set_key")
    names = short.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    worded = base.hot_join(short.where("set_key is not null"), base.materialize(names, "short"), "set_key").select("id", "class_id", "n")
    return worded.union(short.where("set_key is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long")))


def linked_classes(every: DataFrame, df: DataFrame, id_col: str, text_col: str, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """``near_duplicate_classes`` from the sketches of every id; those without a set are no members."""
    one = every.where("size > 0")
    classes = one.groupBy("set_key").agg(F.min("id").alias("class_id"), F.first("size").alias("size"), F.first("registers").alias("registers"), F.count("*").alias("n"))
    # Once written, the number stands for the class until the end.
    classes = base.materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    candidates = candidate_pairs(classes, df, id_col, text_col, cfg)
    links = verified(estimated(candidates, classes, cfg), df, id_col, text_col, classes, cfg)
    members = base.hot_join(one.select("id", "set_key"), classes.select("set_key", "class_id", "n"), "set_key").select("id", "class_id", "n")
    return members, links


def candidate_pairs(classes: DataFrame, df: DataFrame, id_col: str, text_col: str, cfg: NearDupConfig) -> DataFrame:
    """Distinct pairs (a < b, by class number) of classes that agree in all registers of some band."""
    rows, bands = cfg.rows, cfg.bands

    def keys_of(column: pa.Array) -> np.ndarray:
        regs = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, bands, rows).astype(np.uint64)
        h = np.zeros(regs.shape[:2], dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            for r in range(rows):
                h = base.mix(h ^ (regs[:, :, r] + np.uint64(r << 20)))
        return h

    def only_keys(cols: dict) -> dict | None:
        return {"key": base.signed(keys_of(cols["registers"]).ravel())} if len(cols["registers"]) else None

    # Keys alone are counted first: a hot key shrinks to one row per task before the shuffle.
    counts = base.materialize(base.arrow_map(classes.select("registers"), only_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    passing = classes.sparkSession.sparkContext.broadcast(base.bloom(counts, "key"))
    held: list[base.BloomTest] = []

    def shared(cols: dict) -> dict | None:
        if not len(cols["registers"]):
            return None
        if not held:
            held.append(base.BloomTest(passing.value))
        h = keys_of(cols["registers"])
        ok = held[0](h.ravel()).reshape(h.shape)
        who = np.repeat(cols["c"].to_numpy(), ok.sum(axis=1))
        return {"key": base.signed(h[ok]), "c": who}

    rows_of = base.arrow_map(classes.select("c", "registers"), shared, "key long, c long")
    member = base.hot_join(rows_of, counts, "key")
    pairs = (
        member.where(F.col("n") <= cfg.hot_bucket).groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("m"))
        .select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
        .where("a < b").distinct()
    )
    hot = member.where(F.col("n") > cfg.hot_bucket).select("c").distinct()
    if counts.where(F.col("n") > cfg.hot_bucket).limit(1).count() == 0:
        return pairs
    return pairs.union(prefix_pairs(base.materialize(hot, "hot"), df, id_col, text_col, classes, cfg)).distinct()


def class_sets(wanted: DataFrame, df: DataFrame, id_col: str, text_col: str, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(c, hashes) of the wanted classes, from the text of each class's smallest id.

    A fixed-size Bloom filter of the wanted ids keeps all other texts out of Python and out of the shuffle.
    """
    names = classes.join(wanted, "c", "left_semi").select("c", "set_key", F.col("class_id").alias("id")).withColumn("h", F.xxhash64("id"))
    names = base.materialize(names, "wanted")
    passing = df.sparkSession.sparkContext.broadcast(base.bloom(names, "h"))
    held: list = []
    ids, n = base.WordIds(), cfg.shingle

    def run(cols: dict) -> dict | None:
        if not held:
            held.append(base.BloomTest(passing.value))
        keep = pa.array(held[0](cols["h"].to_numpy().view(np.uint64)))
        sets = shingle_sets(cols["text"].filter(keep).to_pylist(), n, ids)
        return {"id": cols["id"].filter(keep), "found": pa.array([_set_key(s) for s in sets], pa.binary()), "hashes": [s.tobytes() for s in sets]}

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")).where("id is not null")
    kind = dict(df.dtypes)[id_col]
    rows = base.arrow_map(source, run, f"id {kind}, found binary, hashes binary")
    # An older delivery of the id may carry another text: only the set that was sketched counts.
    return rows.join(names.select("id", "c", "set_key"), "id").where("found = set_key").groupBy("c").agg(F.first("hashes").alias("hashes"))


def estimated(pairs: DataFrame, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Keep pairs whose joint likelihood estimate reaches threshold - margin."""
    least = cfg.threshold - cfg.margin
    side = classes.select("c", "size", "registers")
    both = (
        pairs.join(side.toDF("a", "size_a", "reg_a"), "a").join(side.toDF("b", "size_b", "reg_b"), "b")
        .where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * cfg.threshold)
    )

    def run(cols: dict) -> dict | None:
        if not len(cols["a"]):
            return None
        ra, rb = (np.frombuffer(b"".join(cols[c].to_pylist()), dtype=np.uint16).reshape(len(cols["a"]), -1) for c in ("reg_a", "reg_b"))
        j = joint_similarity(ra, rb, cols["size_a"].to_numpy().astype(float), cols["size_b"].to_numpy().astype(float))
        keep = pa.array(j >= least)
        return {"a": cols["a"].filter(keep), "b": cols["b"].filter(keep), "estimate": pa.array(j).filter(keep)}

    return base.arrow_map(both, run, "a long, b long, estimate double")


def verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Exact similarity of the pairs on their sets; class ids in order."""
    pairs = base.materialize(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    sets = base.materialize(class_sets(wanted, df, id_col, text_col, classes, cfg), "sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    least = cfg.threshold

    def run(cols: dict) -> dict:
        out = []
        for x, y in zip(cols["set_a"].to_pylist(), cols["set_b"].to_pylist()):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(common / (len(s) + len(t) - common))
        keep = pa.array([j >= least for j in out], pa.bool_())
        return {"a": cols["a"].filter(keep), "b": cols["b"].filter(keep), "similarity": pa.array(out, pa.float64()).filter(keep)}

    exact = base.arrow_map(both.select("a", "b", "set_a", "set_b"), run, "a long, b long, similarity double")
    names = classes.select("c", "class_id")
    named = exact.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def prefix_pairs(hot: DataFrame, df: DataFrame, id_col: str, text_col: str, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Exact candidates among the members of oversized buckets.

    Two sets with similarity of at least t share an element among the first size - ceil(t size) + 1 elements under any
    common order; with the rarest first, the groups that share one are small.
    """
    sets = base.materialize(class_sets(hot, df, id_col, text_col, classes, cfg), "hotsets")

    def spread(cols: dict) -> dict:
        arrays = [np.frombuffer(x, np.int64) for x in cols["hashes"].to_pylist()]
        sizes = [len(a) for a in arrays]
        flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
        return {"c": np.repeat(cols["c"].to_numpy(), sizes), "e": flat, "size": np.repeat(np.array(sizes, np.int32), sizes)}

    elements = base.arrow_map(sets, spread, "c long, e long, size int")
    often = elements.groupBy("e").agg(F.count("*").alias("often"))
    order = elements.join(often, "e").where("often > 1 or size = 1")
    # Elements held by one set only come first in the order and can't be shared; they only use up places.
    alone = elements.join(often.where("often = 1"), "e", "left_semi").groupBy("c").agg(F.count("*").alias("alone"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("c").orderBy("often", "e"))
    prefix = (
        order.withColumn("r", rank).join(alone, "c", "left")
        .where(F.col("r") + F.coalesce("alone", F.lit(0)) <= F.col("size") - F.ceil(F.col("size") * F.lit(cfg.threshold) - 1e-9) + 1)
        .select("e", "c", "size")
    )
    left, right = prefix.toDF("e", "a", "sa"), prefix.toDF("e", "b", "sb")
    close = F.least("sa", "sb") >= F.greatest("sa", "sb") * cfg.threshold
    return left.join(right, "e").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, order_col: str, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row per id: its class, the number of linked classes, and the group (connected classes).  Ids without a set are
    classed by their words and have no links."""
    every = base.materialize(sketches(df, id_col, text_col, order_col, cfg), "one")
    members, links = linked_classes(every, df, id_col, text_col, cfg)
    members = members.union(short_classes(every)).drop("n")
    links = base.materialize(links, "links")
    groups = connected(links.select("class_a", "class_b"))
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return (
        members.join(ends, "class_id", "left").join(groups.toDF("class_id", "group_id"), "class_id", "left")
        .select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )


def connected(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, least node of its component) by alternating large-star and small-star steps; all state stays in tables."""
    edges = base.materialize(links.toDF("u", "v").where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = base.materialize(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    low = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(low, "u", "left_anti").select("u", F.col("u").alias("component"))
    return low.union(roots)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, order_col: str, cfg: NearDupConfig, block: int = BLOCK) -> DataFrame:
    """All pairs of ids (id_a < id_b) of one class or of linked classes: classes are expanded only here, as asked.

    Members stand in blocks of about ``block``, and blocks meet in pairs, so a class of any size spreads over the tasks.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, order_col, cfg)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    members = base.materialize(members.withColumn("blocks", blocks("n")).withColumn("part", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).drop("n"), "members")
    sizes = base.materialize(members.where("id = class_id").select("class_id", "blocks"), "sizes")
    own = sizes.join(members.where("id <> class_id").select("class_id").distinct(), "class_id", "left_semi")  # more than one member
    each = lambda n, start="0": F.explode(F.expr(f"sequence({start}, {n} - 1)"))
    same = own.select("class_id", "blocks", each("blocks").alias("i")).select(F.col("class_id").alias("a"), "i", F.col("class_id").alias("b"), each("blocks", "i").alias("j"))
    across = links.join(sizes.toDF("class_a", "na"), "class_a").join(sizes.toDF("class_b", "nb"), "class_b")
    across = across.select("class_a", "class_b", "nb", each("na").alias("i")).select(F.col("class_a").alias("a"), "i", F.col("class_b").alias("b"), each("nb").alias("j"))
    met = same.union(across).join(members.select(F.col("class_id").alias("a"), F.col("part").alias("i"), F.col("id").alias("x")), ["a", "i"])
    met = met.join(members.select(F.col("class_id").alias("b"), F.col("part").alias("j"), F.col("id").alias("y")), ["b", "j"])
    found = met.where("a <> b or i <> j or x < y")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
