"""Temporal splits, folds and windows. All intervals are half open unless a boundary is a timestamp that ties share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import counted, global_rank, of_column, of_key


def _one(df: DataFrame, *aggs: Column) -> DataFrame:
    """A single row of statistics, joined to all rows as a broadcast."""
    return F.broadcast(df.agg(*aggs))


def rank_split(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split by tx_id at int(n * r); ties may fall on both sides."""
    n = _one(df, F.count("*").alias("_n"))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    return df.crossJoin(n).withColumn("split", F.when(F.col("tx_id") < a, "train").when(F.col("tx_id") < b, "val").otherwise("test")).drop("_n")


def tie_safe_split(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split at the timestamps of the last nominal rows; rows of one timestamp stay together."""
    n = df.agg(F.count("*").alias("_n"))
    at = df.crossJoin(F.broadcast(n)).agg(*(F.max(F.when(F.col("tx_id") == F.floor(F.col("_n") * x) - 1, F.col("ts"))).alias(c) for c, x in (("_t1", train), ("_t2", train + val))))
    return df.crossJoin(F.broadcast(at)).withColumn("split", F.when(F.col("ts") <= F.col("_t1"), "train").when(F.col("ts") <= F.col("_t2"), "val").otherwise("test")).drop("_t1", "_t2")


def calendar_split(df: DataFrame, start: str, train: int, val: int, gap: int, test: int) -> DataFrame:
    """split by days from a date: train, val, gap (embargo), test; null outside."""
    day = F.datediff(F.to_date("ts"), F.lit(start).cast("date"))
    edges = [train, train + val, train + val + gap, train + val + gap + test]
    split = F.when(day < 0, None)
    for name, edge in zip(("train", "val", "gap", "test"), edges, strict=True):
        split = split.when(day < edge, name)
    return df.withColumn("split", split)


def rolling_windows(df: DataFrame, length: int, step: int) -> DataFrame:
    """window, start, end (dates, end exclusive) from the first day on, while end is not after the last day."""
    ends = df.agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    starts = ends.filter(F.date_add("first", length) <= F.col("last")).select("last", F.explode(F.expr(f"sequence(first, date_sub(last, {length}), interval {step} days)")).alias("start"))
    return starts.select((F.datediff("start", F.min("start").over(Window.partitionBy())) / step).cast("int").alias("window"), "start", F.date_add("start", length).alias("end"))


def by_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row with every window that it is in. windows is a list of intervals, one for each period, and small."""
    day = F.to_date("ts")
    return df.join(F.broadcast(windows), (day >= F.col("start")) & (day < F.col("end")))


def daily_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"))


def prefix_counts(daily: DataFrame) -> DataFrame:
    """Every day from the first to the last with the rows and fraud before it."""
    ends = daily.agg(F.min("day").alias("a"), F.date_add(F.max("day"), 1).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return ends.join(daily, "day", "left").select("day", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("rows", "fraud")))


def anchor_support(daily: DataFrame, folds: int, fold_days: int, grid: int) -> DataFrame:
    """anchor, fold, rows, fraud for each anchor on a grid of days and each literal fold after it that is in the data."""
    pre = prefix_counts(daily)
    first = daily.agg(F.min("day").alias("first"))
    anchors = pre.crossJoin(F.broadcast(first)).filter(F.pmod(F.datediff("day", "first"), F.lit(grid)) == 0).select(F.col("day").alias("anchor"))
    edges = anchors.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    edges = edges.select("anchor", "fold", F.expr(f"date_add(anchor, fold * {fold_days})").alias("a"), F.expr(f"date_add(anchor, (fold + 1) * {fold_days})").alias("b"))
    at = lambda side: pre.select(F.col("day").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("rows", "fraud")))
    return edges.join(at("a"), "a").join(at("b"), "b").select("anchor", "fold", (F.col("rows_b") - F.col("rows_a")).alias("rows"), (F.col("fraud_b") - F.col("fraud_a")).alias("fraud"))


def eligible_anchors(support: DataFrame, folds: int, min_fraud: int, min_normal: int) -> DataFrame:
    ok = (F.col("fraud") >= min_fraud) & (F.col("rows") - F.col("fraud") >= min_normal)
    return support.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).alias("good")).filter((F.col("n") == folds) & (F.col("good") == folds)).select("anchor")


def nearest_anchors(anchors: DataFrame, offsets: list[int]) -> DataFrame:
    """For targets at offsets (days) from the middle anchor the nearest one; ties: the earlier."""
    middle = anchors.agg(F.sort_array(F.collect_list("anchor")).alias("all")).select(F.expr("element_at(all, cast(floor((size(all) - 1) / 2) as int) + 1)").alias("middle"))
    targets = middle.select("middle", F.explode(F.array(*map(F.lit, offsets))).alias("offset")).select("offset", F.expr("date_add(middle, offset)").alias("target"))
    near = anchors.crossJoin(F.broadcast(targets)).groupBy("offset", "target").agg(F.min(F.struct(F.abs(F.datediff("anchor", "target")).alias("far"), "anchor")).alias("best"))
    return near.select("offset", "target", F.col("best.anchor").alias("anchor"))


def calendar_folds(folds: list[tuple[str, dict[str, tuple[str, str]]]], spark) -> DataFrame:  # noqa: ANN001
    """fold, role, start, end from a small manifest of named intervals."""
    rows = [(f, r, a, b) for f, roles in folds for r, (a, b) in roles.items()]
    return spark.createDataFrame(rows, "fold string, role string, start string, end string").select("fold", "role", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))


def fold_support(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows and fraud of every fold and role, 0 where there are none; boundaries never move."""
    counts = by_window(df, folds).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"))
    return folds.join(counts, ["fold", "role"], "left").select("fold", "role", "start", "end", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "fraud")))


def parity_blocks(df: DataFrame, share: float = 0.25, block: int = 604_800) -> DataFrame:
    """The last share of rows (with ties of its first timestamp): role selection or calibration by the parity of the week."""
    n = _one(df, F.count("*").alias("_n"))
    at = _one(df.crossJoin(n), F.min(F.when(F.col("tx_id") >= F.floor(F.col("_n") * (1 - share)), F.col("sec"))).alias("_t"))
    rows = df.crossJoin(at).filter(F.col("sec") >= F.col("_t")).drop("_t")
    return rows.withColumn("role", F.when(F.pmod(F.floor(F.col("sec") / block), F.lit(2)) == 0, "selection").otherwise("calibration"))


def selection_tail(df: DataFrame, share: float, min_fraud: int) -> DataFrame:
    """The last share of rows, moved back as far as needed to hold min_fraud positives (all, if there are fewer)."""
    n = df.agg(F.count("*").alias("_n"))
    recent = df.filter("label = 1").select("tx_id").orderBy(F.col("tx_id").desc()).limit(min_fraud).agg(F.min("tx_id").alias("_p"))
    return df.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(recent)).filter(F.col("tx_id") >= F.least(F.floor(F.col("_n") * (1 - share)), F.col("_p"))).drop("_n", "_p")


def source_order_split(df: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """role train or val by source order (a whole number); the boundary is rounded half to even."""
    n = _one(df, F.count("*").alias("_n"))
    ranked = global_rank(df, of_key(order), [order], "_k").crossJoin(n)
    return ranked.withColumn("role", F.when(F.col("_k") <= F.bround(F.col("_n") * share), "train").otherwise("val")).drop("_n", "_k")


def split_statistics(df: DataFrame) -> DataFrame:
    """Rows, fraud, rate in percent, distinct entities, nodes and dates of each split."""
    stats = df.groupBy("split").agg(
        F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"), F.countDistinct("user_key").alias("users"),
        F.countDistinct("merchant_key").alias("merchants"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"),
    )
    return stats.withColumns({"fraud_rate": F.col("fraud") * 100.0 / F.col("rows"), "nodes": F.col("rows") + F.col("users") + F.col("merchants")})


def equal_bins(df: DataFrame, k: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """bin 1..k of nearly equal counts in order; the first n % k are one larger."""
    rows = counted(global_rank(df, of_column(df, order[0]), order, "_r", by), by or [], "_n")
    small, larger = F.floor(F.col("_n") / k), F.col("_n") % k
    in_larger = larger * (small + 1)
    bins = F.when(F.col("_r") <= in_larger, F.ceil(F.col("_r") / (small + 1))).otherwise(larger + F.ceil((F.col("_r") - in_larger) / F.greatest(small, F.lit(1))))
    return rows.withColumn("bin", bins.cast("int")).drop("_r", "_n")


def embargo_ablation(df: DataFrame, gaps: list[int], start: str, train: int, val: int, test: int) -> DataFrame:
    """gap, split, rows, fraud for the same window split with each embargo."""
    each = df.select("ts", "label", F.explode(F.array(*map(F.lit, gaps))).alias("gap"))
    day = F.datediff(F.to_date("ts"), F.lit(start).cast("date"))
    split = F.when(day < 0, None).when(day < train, "train").when(day < train + val, "val").when(day < F.col("gap") + train + val, None).when(day < F.col("gap") + train + val + test, "test")
    return each.withColumn("split", split).filter("split is not null").groupBy("gap", "split").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"))


def window_sweep(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean and sample deviation over windows of each window's rate and mean amount."""
    each = by_window(df, windows).groupBy("window").agg(F.avg(F.col("label").cast("double")).alias("rate"), F.avg("amount").alias("amount"))
    return each.agg(F.count("*").alias("windows"), *(f(c).alias(f"{c}_{n}") for c in ("rate", "amount") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))


def smoke_subset(df: DataFrame, share: float, negatives: int, draw: Column) -> DataFrame:
    """The first share of the positives in time and a hash-drawn number of negatives, in order of time."""
    n = df.filter("label = 1").agg(F.count("*").alias("_n"))
    pos = global_rank(df.filter("label = 1"), of_key("tx_id"), ["tx_id"], "_k").crossJoin(F.broadcast(n)).filter(F.col("_k") <= F.floor(F.col("_n") * share)).drop("_k", "_n")
    neg = df.filter("label = 0").withColumn("_u", draw).orderBy("_u", "tx_id").limit(negatives).drop("_u")
    return pos.unionByName(neg)


def drift(train: DataFrame, test: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    """Shares of test rows whose keys the training rows never had or whose amount is out of their range; whether the boundary ties."""
    ends = F.broadcast(train.agg(F.min(amount).alias("_lo"), F.max(amount).alias("_hi"), F.max("ts").alias("_last")))
    rows = test.crossJoin(ends)
    for k in keys:
        rows = rows.join(train.select(F.col(k).alias(f"_{k}")).distinct(), F.col(k).eqNullSafe(F.col(f"_{k}")), "left")
    unseen = [F.avg((F.col(f"_{k}").isNull() & F.col(k).isNotNull()).cast("double")).alias(f"{k}_unseen") for k in keys]
    outside = F.avg(((F.col(amount) < F.col("_lo")) | (F.col(amount) > F.col("_hi"))).cast("double")).alias("amount_outside")
    return rows.agg(F.count("*").alias("rows"), *unseen, outside, F.max((F.col("ts") == F.col("_last")).cast("int")).alias("boundary_tie"))
