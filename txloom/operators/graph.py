"""The user - transaction - merchant graph as joins and aggregates on its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from ..functions.ranks import global_rank, of_draw, of_key


def entity_codes(df: DataFrame, key: str, out: str = "code") -> DataFrame:
    """Codes 0.. by first appearance: key, code."""
    first = df.groupBy(key).agg(F.min("tx_id").alias("_f"))
    return global_rank(first, of_key("_f"), ["_f"], "_r").select(key, (F.col("_r") - 1).alias(out))


def edges(df: DataFrame) -> DataFrame:
    """relation, src, dst for the four directed relations; ids as text with their side's letter."""
    u, t, m = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("u", "user_key"), ("t", "tx_id"), ("m", "merchant_key")))
    pairs = {"buys": (u, t), "rev_buys": (t, u), "sells": (m, t), "rev_sells": (t, m)}
    each = F.array(*(F.struct(F.lit(r).alias("relation"), a.alias("src"), b.alias("dst")) for r, (a, b) in pairs.items()))
    return df.select(F.explode(each).alias("e")).select("e.*")


def adjacency(df: DataFrame, before: Column | int | None = None) -> DataFrame:
    """side, entity, place (from 0, chronological), tx_id, other: the neighbours of each entity among transactions before a cutoff."""
    rows = df if before is None else df.filter(F.col("tx_id") < before)
    both = F.array(F.struct(F.lit("user").alias("side"), F.col("user_key").cast("long").alias("entity"), F.col("merchant_key").cast("long").alias("other")), F.struct(F.lit("merchant").alias("side"), F.col("merchant_key").cast("long").alias("entity"), F.col("user_key").cast("long").alias("other")))
    long = rows.select("tx_id", "label", F.explode(both).alias("e")).select("e.*", "tx_id", "label")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("side", "entity").orderBy("tx_id")) - 1)


def degrees(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(f"{prefix}_degree"), F.sum("label").cast("long").alias(f"{prefix}_fraud"))


def with_degrees(df: DataFrame) -> DataFrame:
    """d_u, f_u, d_m, f_m, c (shared pair count), cf on each transaction: grouped aggregates joined back, so hubs are pre-aggregated."""
    u = degrees(df, "user_key", "u").withColumnsRenamed({"u_degree": "d_u", "u_fraud": "f_u"})
    m = degrees(df, "merchant_key", "m").withColumnsRenamed({"m_degree": "d_m", "m_fraud": "f_m"})
    p = df.groupBy("user_key", "merchant_key").agg(F.count("*").alias("c"), F.sum("label").cast("long").alias("cf"))
    return df.join(u, "user_key").join(m, "merchant_key").join(p, ["user_key", "merchant_key"])


def node_features(df: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """key, mean_amount and count, both standardised by the mean and population deviation of the training transactions' nodes."""
    nodes = lambda d: d.groupBy(key).agg(F.avg("amount").alias("a"), F.count("*").cast("double").alias("n"))
    fit = F.broadcast(nodes(train).agg(*(f(c).alias(f"{c}_{s}") for c in "an" for s, f in (("m", F.avg), ("s", F.stddev_pop)))))
    z = lambda c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
    return nodes(df).crossJoin(fit).select(key, z("a").alias("mean_amount"), z("n").alias("count"))


def padded_nodes(df: DataFrame) -> DataFrame:
    """node, amount, log_degree, is_tx, is_user, is_merchant for all nodes of the graph."""
    def side(key: str, letter: str) -> DataFrame:
        agg = df.groupBy(key).agg(F.count("*").alias("d"))
        return agg.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("node"), F.lit(0.0).alias("amount"), F.log1p(F.col("d").cast("double")).alias("log_degree"), F.lit(0).alias("is_tx"), F.lit(int(letter == "u")).alias("is_user"), F.lit(int(letter == "m")).alias("is_merchant"))

    tx = df.select(F.concat(F.lit("t"), F.col("tx_id").cast("string")).alias("node"), "amount", F.log1p(F.lit(2.0)).alias("log_degree"), F.lit(1).alias("is_tx"), F.lit(0).alias("is_user"), F.lit(0).alias("is_merchant"))
    return tx.union(side("user_key", "u")).union(side("merchant_key", "m"))


def _draw_normals(df: DataFrame, k: Column, draw: Column) -> DataFrame:
    """All positives and the k normals with the least draw in [0, 1)."""
    ranked = global_rank(df.filter("label = 0").withColumn("_u", draw), of_draw(F.col("_u")), ["_u", "tx_id"], "_r")
    n = F.broadcast(df.agg(F.count("*").alias("_n"), F.sum("label").alias("_p")))
    return df.filter("label = 1").unionByName(ranked.crossJoin(n).filter(F.col("_r") <= k).select(*df.columns))


def undersample_ratio(df: DataFrame, ratio: float, draw: Column) -> DataFrame:
    """floor(positives / ratio) normals; an error if there are too few."""
    p, n = df.agg(F.sum("label"), F.count("*")).first()
    if (p or 0) // ratio > n - (p or 0):
        raise ValueError("too few normal rows for the ratio")
    return _draw_normals(df, F.floor(F.col("_p") / ratio), draw)


def undersample_capped(df: DataFrame, ratio: float, draw: Column) -> DataFrame:
    """floor(positives / ratio) normals, or all if there are fewer."""
    return _draw_normals(df, F.floor(F.col("_p") / ratio), draw)


def undersample_share(df: DataFrame, share: float, draw: Column) -> DataFrame:
    """floor(share of the normals) normals."""
    return _draw_normals(df, F.floor((F.col("_n") - F.col("_p")) * share), draw)


def statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("transactions"), F.countDistinct("user_key").alias("users"), F.countDistinct("merchant_key").alias("merchants")).select(
        "*", (F.col("transactions") + F.col("users") + F.col("merchants")).alias("nodes"), (F.col("transactions") * 2).alias("undirected_edges"), (F.col("transactions") * 4).alias("directed_edges")
    )


def coordinates(df: DataFrame) -> DataFrame:
    """row, col of the adjacency matrix from 1: transactions first, then users, then merchants, each side in order of its key."""
    n = F.broadcast(df.agg(F.count("*").alias("_n"), F.countDistinct("user_key").alias("_u")))
    u, m = (global_rank(df.select(k).distinct(), of_key(k), [k], c) for k, c in (("user_key", "_cu"), ("merchant_key", "_cm")))
    rows = df.select("tx_id", "user_key", "merchant_key").join(u, "user_key").join(m, "merchant_key").crossJoin(n)
    t, cu, cm = F.col("tx_id") + 1, F.col("_n") + F.col("_cu"), F.col("_n") + F.col("_u") + F.col("_cm")
    each = F.array(*(F.struct(a.alias("row"), b.alias("col")) for a, b in ((t, cu), (cu, t), (t, cm), (cm, t))))
    return rows.select(F.explode(each).alias("e")).select("e.row", "e.col")


def majority_label(df: DataFrame, key: str) -> DataFrame:
    """1 if at least half of the known labels are positive, else 0; -1 if none is known."""
    rate = F.avg("label")
    return df.groupBy(key).agg(F.when(rate.isNull(), -1).when(rate >= 0.5, 1).otherwise(0).alias("majority"))


def pair_jaccard() -> Column:
    """Shared transactions over the union of both histories (needs d_u, d_m, c)."""
    j = F.col("c") / F.greatest(F.col("d_u") + F.col("d_m") - F.col("c"), F.lit(1))
    return F.least(F.greatest(j, F.lit(0.0)), F.lit(1.0))


def attribute_homophily(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """(1 + cosine of the transaction's features and its entity's mean) / 2, with 0 for a zero vector's cosine."""
    means = df.groupBy(key).agg(*(F.avg(c).alias(f"_{c}") for c in features))
    j = df.join(means, key)
    dot = sum((F.col(c) * F.col(f"_{c}") for c in features), F.lit(0.0))
    size = lambda p: F.sqrt(sum((F.col(f"{p}{c}") ** 2 for c in features), F.lit(0.0)))
    norm = size("") * size("_")
    return j.withColumn("homophily", (1 + F.when(norm > 1e-12, dot / norm).otherwise(0.0)) / 2).drop(*(f"_{c}" for c in features))


def pagerank(df: DataFrame, beta: float = 0.15, steps: int = 3) -> DataFrame:
    """side, entity, rank: power iteration on users and merchants with uniform teleport, min-max scaled on each side.

    Parallel edges are one weighted edge, so a step is one join and one sum of pairs, not transactions; lineage is cut every three steps.
    """
    pairs = df.groupBy("user_key", "merchant_key").agg(F.count("*").alias("w"))
    arcs = pairs.select(F.struct(F.lit("u").alias("s"), F.col("user_key").cast("long").alias("e")).alias("a"), F.struct(F.lit("m").alias("s"), F.col("merchant_key").cast("long").alias("e")).alias("b"), "w")
    arcs = cut(arcs.union(arcs.select("b", "a", "w")))
    out = arcs.groupBy("a").agg(F.sum("w").alias("d"))
    nodes = cut(out.crossJoin(F.broadcast(out.agg(F.count("*").alias("_n")))))
    flow = cut(arcs.join(nodes, "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")))  # what every step reads
    rank = nodes.select("a", "_n", (F.lit(1.0) / F.col("_n")).alias("r"))
    for k in range(steps):
        inflow = flow.join(rank.select("a", "r"), "a").groupBy("b").agg(F.sum(F.col("p") * F.col("r")).alias("in"))
        rank = nodes.join(inflow.withColumnRenamed("b", "a"), "a", "left").select("a", "_n", (F.lit(beta) / F.col("_n") + (1 - beta) * F.coalesce("in", F.lit(0.0))).alias("r"))
        if k % 3 == 2 and k < steps - 1:
            rank = cut(rank)
    ends = rank.groupBy(F.col("a.s").alias("side")).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    scaled = (F.col("r") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return rank.select(F.col("a.s").alias("side"), F.col("a.e").alias("entity"), "r").join(F.broadcast(ends), "side").select("side", "entity", scaled.alias("rank"))


def ppr_weight(d: str, other: str, alpha: float = 0.85) -> Column:
    """Three-step personalised PageRank from an entity to one of its transactions, in closed form.

    From the entity a step reaches each transaction with 1/d; from there half goes back, half to the other endpoint, from which the
    shared transactions come back: beta a / d + a**3 / (2 d) (1 + c / d').
    """
    a, b = alpha, 1 - alpha
    return a * b / F.col(d) + a**3 / (2 * F.col(d)) * (1 + F.col("c") / F.col(other))


def ppr_by_steps(df: DataFrame, alpha: float = 0.85) -> DataFrame:
    """user_key, tx_id, ppr by propagation along the edges: the slow twin of ppr_weight, for tests.

    A walk from a user stops with 1 - alpha at each transaction it reaches in its first step, and for good in its third.
    """
    d = with_degrees(df).select("tx_id", "user_key", "merchant_key", "d_m", "d_u")
    at = d.withColumn("p", F.lit(alpha) / F.col("d_u"))
    stop = at.select("user_key", "tx_id", (F.col("p") * (1 - alpha)).alias("p"))
    back = at.groupBy("user_key").agg(F.sum(F.col("p") * alpha / 2).alias("at"))
    via_user = d.join(back, "user_key").select("user_key", "tx_id", (F.col("at") * alpha / F.col("d_u")).alias("p"))
    across = at.groupBy("user_key", "merchant_key").agg(F.sum(F.col("p") * alpha / 2).alias("at"))
    via_merchant = d.join(across, ["user_key", "merchant_key"]).select("user_key", "tx_id", (F.col("at") * alpha / F.col("d_m")).alias("p"))
    return stop.union(via_user).union(via_merchant).groupBy("user_key", "tx_id").agg(F.sum("p").alias("ppr"))


def historical_homophily(d: str, f: str, smoothing: float = 20, prior: float = 0.5) -> Column:
    """Share of the entity's other transactions that have the same label, pulled to a prior."""
    n, pos = F.col(d) - 1, F.col(f) - F.col("label")
    same = F.when(F.col("label") == 1, pos).otherwise(n - pos)
    return (same + smoothing * prior) / (n + smoothing)


def projected_degree() -> Column:
    """Transactions that share an endpoint (d_u + d_m - c - 1)."""
    return F.col("d_u") + F.col("d_m") - F.col("c") - 1


def reciprocal_degree() -> Column:
    return 1 / F.sqrt(F.col("d_u").cast("double") * F.col("d_m"))


def label_homophily() -> Column:
    """Legacy: share of the user's transactions with this label."""
    return F.when(F.col("label") == 1, F.col("f_u")).otherwise(F.col("d_u") - F.col("f_u")) / F.col("d_u")


def counterpart_score(d: str, inverse: bool = True) -> Column:
    """1 / ln(1 + d), or ln(1 + d); a degree below 1 counts as 1."""
    x = F.log1p(F.greatest(F.col(d), F.lit(1)).cast("double"))
    return 1 / x if inverse else x


def floored(df: DataFrame, value: str, by: list[str], alpha: float = 0.1, power: float = 1.0, mode: str = "convex", out: str = "weight") -> DataFrame:
    """Min-max scaled per relation, to a power, with a floor: `add` gives scaled + alpha, `convex` alpha + (1 - alpha) scaled."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.pow((F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0), F.lit(power))
    w = scaled + alpha if mode == "add" else alpha + (1 - alpha) * scaled
    return (df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))).withColumn(out, w).drop("_lo", "_hi")


def causal_context(df: DataFrame, day: str) -> DataFrame:
    """Earlier transactions that share a user or a merchant with the day's."""
    start = F.lit(day).cast("date")
    target, history = df.filter(F.to_date("ts") == start), df.filter(F.to_date("ts") < start)
    near = [history.join(target.select(k).distinct(), k, "left_semi").select("tx_id") for k in ("user_key", "merchant_key")]
    return near[0].union(near[1]).distinct()


def causal_edges(df: DataFrame, day: str) -> DataFrame:
    """Edges of a day's graph: both directions for history, only towards the target for the day's transactions."""
    start = F.lit(day).cast("date")
    history = edges(df.filter(F.to_date("ts") < start))
    targets = edges(df.filter(F.to_date("ts") == start)).filter(F.col("relation").isin("buys", "sells"))
    return history.union(targets)


def camouflage(train: DataFrame, df: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """tx_id, seen, normal_share, masked: positives whose two-hop training history is mostly normal; shared rows count once, unknown isn't normal."""
    u = degrees(train, "user_key", "u").withColumnsRenamed({"u_degree": "d_u", "u_fraud": "f_u"})
    m = degrees(train, "merchant_key", "m").withColumnsRenamed({"m_degree": "d_m", "m_fraud": "f_m"})
    p = train.groupBy("user_key", "merchant_key").agg(F.count("*").alias("c"), F.sum("label").cast("long").alias("cf"))
    j = df.join(u, "user_key", "left").join(m, "merchant_key", "left").join(p, ["user_key", "merchant_key"], "left").fillna(0, ["d_u", "f_u", "d_m", "f_m", "c", "cf"])
    n, f = F.col("d_u") + F.col("d_m") - F.col("c"), F.col("f_u") + F.col("f_m") - F.col("cf")
    share = F.when(n > 0, (n - f) / n)
    return j.select("tx_id", n.alias("seen"), share.alias("normal_share"), ((F.col("label") == 1) & F.coalesce(share > cutoff, F.lit(False))).cast("int").alias("masked"))


def neighbour_means(neighbours: DataFrame, features: DataFrame, columns: list[str], entity: str = "entity") -> DataFrame:
    """entity and the mean of its sampled neighbours' features; aggregated before any join to roots."""
    return neighbours.join(features, "tx_id").groupBy(entity).agg(*(F.avg(c).alias(c) for c in columns))


def spectral_sketch(df: DataFrame, width: int = 8, seed: int = 42):  # noqa: ANN201
    """(user_key, embedding) from D^-1/2 A D^-1/2 times a sign sketch, and the width x width Gram matrix's spectrum from the driver."""
    import numpy as np

    from ..sources.fixtures import uniform

    pairs = df.groupBy("user_key", "merchant_key").agg(F.count("*").alias("w"))
    du, dm = (pairs.groupBy(k).agg(F.sum("w").alias(d)) for k, d in (("user_key", "du"), ("merchant_key", "dm")))
    walk = pairs.join(du, "user_key").join(dm, "merchant_key").withColumn("v", F.col("w") / F.sqrt(F.col("du").cast("double") * F.col("dm")))
    signs = [F.sum(F.col("v") * F.when(uniform(seed, F.lit(k), "merchant_key") < 0.5, -1.0).otherwise(1.0)).alias(f"s{k}") for k in range(width)]
    sketch = walk.groupBy("user_key").agg(*signs)
    gram = sketch.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width))).first()
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(g)
    basis = vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-12))
    basis = basis * np.where(np.take_along_axis(basis, np.abs(basis).argmax(0)[None], 0) < 0, -1, 1)
    embed = [sum((F.col(f"s{i}") * float(basis[i, k]) for i in range(width)), F.lit(0.0)) for k in range(width)]
    return sketch.select("user_key", F.array(*embed).alias("embedding"))
