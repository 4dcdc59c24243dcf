"""Reproducible samples: every draw is a hash of (seed, what it is for, row), so reruns, other engines and other orders agree."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import stored
from ..functions.ranks import global_rank, of_draw, of_key
from ..sources.fixtures import uniform

#: Edges and roots that are drawn together at a time; days that count as recent.
UNIT, RECENT_DAYS = 8192, 180


def clamped(u: Column) -> Column:
    return F.greatest(F.least(u, F.lit(1 - 2.0**-53)), F.lit(2.0**-53))


def gumbel(u: Column, weight: Column | None = None) -> Column:
    """ln w - ln(-ln u): the k greatest are a weighted sample without replacement (Plackett-Luce)."""
    g = -F.log(-F.log(clamped(u)))
    return g if weight is None else F.log(weight) + g


def top_k(df: DataFrame, by: list[str], score: Column, k: int, tie: str = "tx_id") -> DataFrame:
    """The k greatest scores of each group with rank 1..k; a group of k or fewer stays whole."""
    w = Window.partitionBy(*by).orderBy(F.col("_g").desc(), tie)
    return df.withColumn("_g", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_g")


def neighbours(edges: DataFrame, k: int, seed: int, by: str = "entity", weight: str | None = None) -> DataFrame:
    """k neighbours of each entity without replacement, uniform or by weight."""
    return top_k(edges, [by], gumbel(uniform(seed, by, "tx_id"), F.col(weight) if weight else None), k)


def _units(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """entity, unit, is_root, id, day: roots and edges dealt to units, each with about UNIT of either at most.

    An entity of more rows has several parts of its edges and of its roots, and a unit for each pair of parts. The table of such
    entities has at most a UNIT-th of the rows.
    """
    rows = edges.select("entity", F.lit(0).alias("is_root"), F.col("tx_id").cast("long").alias("id"), "day").union(roots.select("entity", F.lit(1), F.col("root").cast("long"), "day"))
    rows = rows.filter("entity IS NOT NULL")
    sizes = rows.groupBy("entity").agg(F.ceil(F.sum(1 - F.col("is_root")) / UNIT).alias("_e"), F.ceil(F.sum("is_root") / UNIT).alias("_r"))
    large = sizes.filter("_e > 1 OR _r > 1").select("entity", F.greatest("_e", F.lit(1)).alias("_e"), F.greatest("_r", F.lit(1)).alias("_r"))
    dealt = rows.join(F.broadcast(large), "entity", "left").fillna(1, ["_e", "_r"])
    part = F.pmod(F.xxhash64("id"), F.when(F.col("is_root") == 1, F.col("_r")).otherwise(F.col("_e")))
    mine = F.when(F.col("is_root") == 1, F.transform(F.sequence(F.lit(0), F.col("_e") - 1), lambda e: e * F.col("_r") + part)).otherwise(F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda r: part * F.col("_r") + r))
    return dealt.select("entity", F.explode(mine).alias("unit"), "is_root", "id", "day")


def _drawn(prefix: bytes, ids: list[bytes]) -> np.ndarray:
    """The 52 bits of uniform() of each id, as whole numbers."""
    digests = b"".join([hashlib.sha256(prefix + t).digest() for t in ids])
    return np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> np.uint64(12)


def _greatest(draw: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest draws, ties to the least id."""
    at = np.arange(len(draw))
    if len(draw) > k:
        at = np.flatnonzero(draw >= np.partition(draw, len(draw) - k)[len(draw) - k])
    return at[np.lexsort((ids[at], ~draw[at]))[:k]]


def _unit_draws(edges: tuple[np.ndarray, np.ndarray], roots: tuple[np.ndarray, np.ndarray], k: int, seed: int, before: bool, recent: bool) -> list[np.ndarray]:
    """root, tx_id, draw, new of the k greatest draws of each root of a unit (of each of old and new, where recent)."""
    order = np.argsort(edges[1], kind="stable")
    ids, days = edges[0][order], edges[1][order]
    texts = [b"%d" % i for i in ids.tolist()]
    found: list[list[np.ndarray]] = [[], [], [], []]
    for root, day in zip(roots[0].tolist(), roots[1].tolist(), strict=True):
        n = int(np.searchsorted(days, day)) if before else len(ids)
        draw = _drawn(b"%d|%d|" % (seed, root), texts[:n])
        old = int(np.searchsorted(days[:n], day - RECENT_DAYS)) if recent else 0
        for new, a, b in ((0, 0, old), (1, old, n)):
            other = a + np.flatnonzero(ids[a:b] != root)
            best = other[_greatest(draw[other], ids[other], k)]
            for column, x in zip(found, (np.full(len(best), root), ids[best], draw[best].astype(np.int64), np.full(len(best), new)), strict=True):
                column.append(x)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]


def causal_neighbours(roots: DataFrame, edges: DataFrame, k: int, seed: int, mode: str = "moving", fit_end: str | None = None, recent: int | None = None) -> DataFrame:
    """root, tx_id, rank: neighbours of each root's entity by time.

    static: all edges; frozen: before fit_end; moving: before the root's day; recent: as moving, `recent` of the k from the last 180
    days, the rest older, filled up with recent ones. roots: root, entity, day; edges: entity, tx_id, ts; ids are whole numbers.

    Every pair of a root and an edge has a draw of its own. Pairs are drawn as a stream, a unit of an entity's edges and roots at a
    time, of which only each root's k best leave: no pair is ever sorted or exchanged. The order by draw is the order by gumbel().
    """
    before = mode not in ("static", "frozen")
    if mode == "frozen":
        edges = edges.filter(F.col("ts") < F.lit(fit_end).cast("timestamp_ntz"))
    number = lambda day: F.datediff(day, F.lit("1970-01-01").cast("date"))
    a = roots.select("entity", "root", (number(F.col("day")) if before else F.lit(0)).alias("day")).filter("day IS NOT NULL")
    b = edges.select("entity", "tx_id", (number(F.to_date("ts")) if before else F.lit(0)).alias("day")).filter("day IS NOT NULL")
    keys = ["entity", "unit"]
    dealt = _units(a, b).repartition(*keys).sortWithinPartitions(*keys, "is_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
            if not held:
                continue
            entity, unit = (held.column(c).combine_chunks() for c in keys)
            new = pc.or_(pc.not_equal(entity[1:], entity[:-1]), pc.not_equal(unit[1:], unit[:-1])).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(new) + 1).tolist(), *([] if batch is not None else [len(held)])]
            is_root, ids, days = (held.column(c).to_numpy() for c in ("is_root", "id", "day"))
            for start, end in itertools.pairwise(ends):
                split = start + int(np.searchsorted(is_root[start:end], 1))
                if start < split < end:
                    found = _unit_draws((ids[start:split], days[start:split]), (ids[split:end], days[split:end]), k, seed, before, mode == "recent")
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["root", "tx_id", "_u", "_new"])
            held = held.slice(ends[-1]).combine_chunks()

    j = dealt.mapInArrow(run, "root long, tx_id long, _u long, _new long")
    kinds = {"root": dict(roots.dtypes)["root"], "tx_id": dict(edges.dtypes)["tx_id"]}
    out = ["rank" if c == "rank" else F.col(c).cast(kinds[c]).alias(c) for c in ("root", "tx_id", "rank")]
    if mode != "recent":
        return top_k(j, ["root"], F.col("_u"), k).select(*out)
    j = j.withColumn("_r", F.row_number().over(Window.partitionBy("root", "_new").orderBy(F.col("_u").desc(), "tx_id")))
    tier = F.when((F.col("_new") == 1) & (F.col("_r") <= recent), 0).when(F.col("_new") == 0, 1).otherwise(2)
    w = Window.partitionBy("root").orderBy(tier, "_r", "tx_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*out)


def two_layers(roots: DataFrame, adjacency: DataFrame, fanout: tuple[int, int], seed: int) -> DataFrame:
    """root, layer, dst, src: a root takes both endpoints' sampled transactions, and each of those its endpoints'.

    adjacency: side, entity, tx_id, other (a row for each end of a transaction); roots: its rows of the roots, each once. What an entity
    passes on is one list: its sample with the sample's own samples. Each root's ends read it, so no row of the result is exchanged. A
    transaction that a root would get from both ends shares both with it, and then the merchant's side leaves it out.
    """
    key = ["side", "entity"]
    rows = adjacency.select(*key, "tx_id", "other").filter("entity IS NOT NULL")
    draw = lambda s: uniform(s, F.concat_ws(":", "side", "entity"), "tx_id")
    near, far = (stored(top_k(rows, key, draw(seed + i), k).select(*key, "tx_id", "other")) for i, k in enumerate(fanout))
    lists = near.groupBy(*key).agg(F.collect_list("tx_id").alias("_near")).join(far.groupBy(*key).agg(F.collect_list("tx_id").alias("_far")), key, "left")
    there = lists.select(F.when(F.col("side") == "user", "merchant").otherwise("user").alias("side"), F.col("entity").alias("other"), F.col("_near").alias("_there"), F.col("_far").alias("_over"))
    none = F.array().cast(dict(lists.dtypes)["_far"])
    twice = F.coalesce((F.col("side") == "merchant") & F.array_contains("_there", F.col("tx_id")), F.lit(False))
    entry = F.struct("tx_id", F.col("other").alias("via"), twice.alias("twice"), F.coalesce("_over", none).alias("over"))
    passed = near.join(there, ["side", "other"], "left").groupBy(*key).agg(F.collect_list(entry).alias("_e")).join(lists.select(*key, F.coalesce("_far", none).alias("_far")), key)
    # a sampled transaction first, then its own sample
    each = F.transform("_e", lambda e: F.struct(e["via"].alias("via"), e["twice"].alias("twice"), F.concat(F.array(e["tx_id"]), F.array_remove(F.array_union(F.col("_far"), e["over"]), e["tx_id"])).alias("ids")))
    at = roots.select(*key, F.col("tx_id").alias("root"), "other").join(passed.select(*key, each.alias("_e")), key).select("root", "other", F.explode("_e").alias("e"))
    at = at.filter((F.col("e.ids")[0] != F.col("root")) & ~(F.col("e.twice") & F.col("e.via").eqNullSafe(F.col("other"))))
    out = at.select("root", F.col("e.ids")[0].alias("_s"), F.posexplode("e.ids").alias("_at", "src"))
    return out.select("root", F.when(F.col("_at") == 0, 1).otherwise(2).alias("layer"), F.when(F.col("_at") == 0, F.col("root")).otherwise(F.col("_s")).alias("dst"), "src")


def frontier(roots: DataFrame, adjacency: DataFrame, hops: int, k: int, seed: int) -> DataFrame:
    """tx_id, hop: new transactions of each hop over the sampled neighbours; what was seen doesn't come again."""
    keyed = adjacency.withColumn("key", F.concat_ws(":", "side", "entity"))
    seen = roots.select(F.col("root").alias("tx_id"), F.lit(0).alias("hop"))
    now = seen
    for hop in range(1, hops + 1):
        table = neighbours(keyed, k, seed + hop, "key").select("key", "tx_id")
        ends = keyed.select(F.col("tx_id").alias("t"), "key").join(now.select(F.col("tx_id").alias("t")), "t", "left_semi").select("key").distinct()
        now = ends.join(table, "key").select("tx_id").distinct().join(seen, "tx_id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(now)
    return seen


def contract(weights: DataFrame, by: str, weight: str, floor: float) -> DataFrame:
    """not_finite, not_positive, below_floor, empty_groups: all must be 0."""
    w = F.col(weight)
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) < float("inf"))
    rows = weights.agg(F.count(F.when(~finite, 1)).alias("not_finite"), F.count(F.when(w <= 0, 1)).alias("not_positive"), F.count(F.when(w < floor, 1)).alias("below_floor"))
    groups = weights.groupBy(by).agg(F.sum(weight).alias("_s")).agg(F.count(F.when(~(F.col("_s") > 0), 1)).alias("empty_groups"))
    return rows.crossJoin(F.broadcast(groups))


def weight_audit(weights: DataFrame, by: str, weight: str) -> DataFrame:
    return weights.groupBy(by).agg(F.min(weight).alias("min"), F.max(weight).alias("max"), F.avg(weight).alias("mean"), F.stddev_pop(weight).alias("std"), F.countDistinct(weight).alias("unique"))


def balanced_roots(df: DataFrame, ratio: int, epoch: int, seed: int) -> DataFrame:
    """All positives and ratio times as many normals, drawn anew in each epoch."""
    n = F.broadcast(df.agg((F.sum("label") * ratio).alias("_k")))
    drawn = df.filter("label = 0").withColumn("_u", uniform(seed, F.lit(epoch), "tx_id"))
    drawn = global_rank(drawn, of_draw(F.col("_u")), ["_u", "tx_id"], "_r")
    return df.filter("label = 1").unionByName(drawn.crossJoin(n).filter("_r <= _k").select(*df.columns))


def stratified_roots(df: DataFrame, strata: list[str], normals: int, seed: int) -> DataFrame:
    """Normals in proportion to each stratum's positives (rounded down), filled up from all strata, with all positives."""
    share = df.filter("label = 1").groupBy(*strata).agg(F.count("*").alias("_p"))
    total = F.broadcast(df.agg(F.sum("label").alias("_t")))
    quota = share.crossJoin(total).withColumn("_q", F.floor(F.col("_p") * normals / F.col("_t"))).select(*strata, "_q")
    drawn = df.filter("label = 0").withColumn("_u", uniform(seed, "tx_id")).join(quota, strata, "left").fillna(0, ["_q"])
    drawn = global_rank(drawn, of_draw(F.col("_u")), ["_u", "tx_id"], "_r", strata).withColumn("_over", (F.col("_r") > F.col("_q")).cast("int"))
    # at most `normals` rows leave, so this is a distributed top-k, not a rank of all
    return df.filter("label = 1").unionByName(drawn.orderBy("_over", "_u", "tx_id").limit(normals).select(*df.columns))


def cohort(df: DataFrame, n: int, fraud_cap: int, seed: int) -> DataFrame:
    """A sample of all rows together with the positives (at most fraud_cap, drawn by hash)."""
    u = uniform(seed, "tx_id")
    some = df.withColumn("_u", u).orderBy("_u", "tx_id").limit(n).drop("_u")
    pos = df.filter("label = 1").withColumn("_u", u).orderBy("_u", "tx_id").limit(fraud_cap).drop("_u")
    return some.union(pos).distinct()


def majority_down(df: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each label."""
    return top_k(df, ["label"], -uniform(seed, "tx_id"), most).drop("rank")


def inclusion(edges: DataFrame, draws: int, k: int, seed: int, by: str = "entity", weight: str | None = None) -> DataFrame:
    """entity, tx_id, inclusion: share of the draws in which a neighbour is taken. Draws run side by side."""
    each = edges.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    g = gumbel(uniform(seed, "draw", by, "tx_id"), F.col(weight) if weight else None)
    taken = top_k(each, ["draw", by], g, k).groupBy(by, "tx_id").agg((F.count("*") / F.lit(draws)).alias("inclusion"))
    return edges.select(by, "tx_id").join(taken, [by, "tx_id"], "left").fillna(0.0, ["inclusion"])


def picked_groups(sizes: DataFrame, order: list[str], k: int) -> DataFrame:
    """k groups evenly over a total order, ends included (positions rounded half to even)."""
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(*order)) - 1)
    at = sizes.agg(F.count("*").alias("_n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("int"))).alias("_r")).distinct()
    return ranked.join(F.broadcast(at), "_r").drop("_r")


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """batch 0.. of `size` rows in order of a whole number; a last batch of one row joins the one before."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    r = global_rank(df, of_key(order), [order], "_r").withColumn("_r", F.col("_r") - 1).crossJoin(n)
    raw = F.floor(F.col("_r") / size)
    alone = (F.col("_n") % size == 1) & (F.col("_n") > 1) & (F.col("_r") == F.col("_n") - 1)
    return r.withColumn("batch", F.when(alone, raw - 1).otherwise(raw)).drop("_r", "_n")


def permuted_block(df: DataFrame, columns: list[str], seed: int, key: str = "tx_id") -> DataFrame:
    """The block of columns re-paired with other rows by a hash order; the other columns stay."""
    a = global_rank(df.drop(*columns), of_key(key), [key], "_r")
    b = df.select(*columns, uniform(seed, key).alias("_u"), F.col(key).alias("_k"))
    b = global_rank(b, of_draw(F.col("_u")), ["_u", "_k"], "_r").drop("_u", "_k")
    return a.join(b, "_r").drop("_r")
