"""Strictly-past behaviour: a row's history is the rows of its group with an earlier second.

Rows of the same second see the same history, so results don't depend on the order of input. Frames that end at -1 on
integer seconds say just that. A frame of the last N seconds is the difference of two unbounded frames, which Spark
evaluates in one pass, where a bounded range frame would be evaluated anew for every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import counted, global_rank, of_column

HOUR, DAY, WEEK = 3600, 86_400, 604_800


def signed_log(amount: Column | str = "amount") -> Column:
    """sign(x) * ln(1 + |x|); null for null, NaN and infinities."""
    x = F.col(amount) if isinstance(amount, str) else amount
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.signum(x) * F.log1p(F.abs(x)))


def clip(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(most))), F.lit(-float(most)))


class Past:
    """Aggregates over the history of a group; last: only the last so many seconds."""

    def __init__(self, *keys: str, order: str = "sec") -> None:
        self.window = Window.partitionBy(*keys).orderBy(order)
        self.order = order

    def _frame(self, end: int):  # noqa: ANN202
        return self.window.rangeBetween(Window.unboundedPreceding, end)

    def _over(self, agg: Column, last: int | None) -> Column:
        whole = F.coalesce(agg.over(self._frame(-1)), F.lit(0))
        return whole if last is None else whole - F.coalesce(agg.over(self._frame(-last - 1)), F.lit(0))

    def count(self, x: Column | None = None, last: int | None = None) -> Column:
        return self._over(F.count(F.lit(1) if x is None else x), last)

    def sum(self, x: Column, last: int | None = None) -> Column:
        return self._over(F.sum(x), last)

    def age(self) -> Column:
        """Seconds since the last earlier row; null without history."""
        return F.col(self.order) - F.max(self.order).over(self._frame(-1))

    def delta_z(self, x: Column, last: int | None = None) -> tuple[Column, Column, Column]:
        """(difference to the past mean / 5, its z-score / 5, both clipped; number of valid rows); 0 where undefined."""
        n = self.count(x, last)
        mean = self.sum(x, last) / n
        var = F.greatest(self.sum(x * x, last) / n - mean * mean, F.lit(0.25))
        known = x.isNotNull() & (n > 0)
        return F.when(known, clip(x - mean, 10) / 5).otherwise(0.0), F.when(known, clip((x - mean) / F.sqrt(var), 10) / 5).otherwise(0.0), n


def log_scaled(n: Column, scale: float) -> Column:
    return F.log1p(n.cast("double")) / scale


def entity_features(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Count, coldness, recency, activity and amount features of one entity's history."""
    past, x = Past(key), signed_log()
    n = past.count()
    delta, z, _ = past.delta_z(x)
    return df.withColumns({
        f"{prefix}_prior_count_log": log_scaled(n, 10),
        f"{prefix}_cold_start": (n == 0).cast("int"),
        f"{prefix}_since_previous_log": F.coalesce(log_scaled(past.age(), 16), F.lit(0.0)),
        f"{prefix}_count_1h_log": log_scaled(past.count(last=HOUR), 5),
        f"{prefix}_count_24h_log": log_scaled(past.count(last=DAY), 5),
        f"{prefix}_count_7d_log": log_scaled(past.count(last=WEEK), 5),
        f"{prefix}_amount_log_delta": delta,
        f"{prefix}_amount_log_z": z,
    })


def pair_features(df: DataFrame, key: str, others: list[str], prefix: str) -> DataFrame:
    """For key x other: new (never together) and surprisal ln((n_key + 1) / (n_pair + 1)) / 10."""
    n = Past(key).count()
    added: dict[str, Column] = {}
    for other in others:
        pair = Past(key, other).count()
        added[f"{prefix}_{other}_new"] = (pair == 0).cast("int")
        added[f"{prefix}_{other}_surprisal"] = F.log((n + 1) / (pair + 1)) / 10
    return df.withColumns(added)


def recent_amount_features(df: DataFrame, key: str, prefix: str, last: int = WEEK) -> DataFrame:
    """Amount features against the last seven days and the support they rest on."""
    delta, z, n = Past(key).delta_z(signed_log(), last)
    return df.withColumns({f"{prefix}_amount_7d_delta": delta, f"{prefix}_amount_7d_z": z, f"{prefix}_amount_7d_support_log": log_scaled(n, 5)})


def rhythm_features(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Deviation from the circular mean hour, its concentration, and the last day's share of the last week."""
    past = Past(key)
    phi = (F.hour("ts") + F.minute("ts") / 60.0) * (2 * 3.141592653589793 / 24)
    n = past.count()
    s, c = past.sum(F.sin(phi)) / n, past.sum(F.cos(phi)) / n
    return df.withColumns({
        f"{prefix}_hour_deviation": F.when(n > 0, (1 - s * F.sin(phi) - c * F.cos(phi)) / 2).otherwise(0.0),
        f"{prefix}_hour_concentration": F.when(n > 0, F.sqrt(s * s + c * c)).otherwise(0.0),
        f"{prefix}_activity_share": past.count(last=DAY) / F.greatest(past.count(last=WEEK), F.lit(1)),
    })


def conditional_features(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Support, coldness, recency and amounts of the history of a combination of keys."""
    past = Past(*keys)
    n = past.count()
    delta, z, _ = past.delta_z(signed_log())
    return df.withColumns({
        f"{prefix}_support_log": log_scaled(n, 10),
        f"{prefix}_cold_start": (n == 0).cast("int"),
        f"{prefix}_recency_log": F.coalesce(log_scaled(past.age(), 16), F.lit(0.0)),
        f"{prefix}_amount_delta": delta,
        f"{prefix}_amount_z": z,
    })


def two_level(df: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    """conditional sums for keys that one group may dominate: aggregated by (keys, second) before the window, joined back after.

    Adds past_count, past_sum and past_valid.
    """
    x = signed_log(amount)
    by_second = df.groupBy(*keys, "sec").agg(F.count("*").alias("_n"), F.count(x).alias("_v"), F.sum(x).alias("_s"))
    frame = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    keyed = [F.col(k).alias(f"_{k}") for k in [*keys, "sec"]]
    past = by_second.select(*keyed, *(F.coalesce(F.sum(a).over(frame), F.lit(0)).alias(b) for a, b in (("_n", "past_count"), ("_v", "past_valid"), ("_s", "past_sum"))))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "sec"]))
    return df.join(past, same).select(*df.columns, "past_count", "past_valid", "past_sum")


def episodes(df: DataFrame, keys: list[str], gap: int = WEEK) -> DataFrame:
    """Positive rows with episode_start (gap to the previous positive over `gap` seconds, or none) and episode number.

    Positives of one second are one step: the gap between them is 0.
    """
    w = Window.partitionBy(*keys).orderBy("sec", "tx_id")
    start = F.coalesce((F.col("sec") - F.lag("sec").over(w) > gap).cast("int"), F.lit(1))
    rows = df.filter("label = 1").withColumn("episode_start", start)
    return rows.withColumn("episode", F.sum("episode_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def daily_history(df: DataFrame, key: str, prefix: str, value: str = "amount") -> DataFrame:
    """Count and mean of all rows of earlier days: what is known of an entity when a day begins."""
    by_day = df.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    frame = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n, s = (F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in ("_n", "_s"))
    known = by_day.select(key, "day", n.alias(f"{prefix}_degree"), F.when(n > 0, s / n).otherwise(0.0).alias(f"{prefix}_mean"))
    return df.withColumn("day", F.to_date("ts")).join(known, [key, "day"])


def rank_quartiles(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, bins: int = 4) -> DataFrame:
    """bin 0..bins-1 by quantile edges of the rank (first come in `order`): edges at 1 + k * (n - 1) / bins, right-closed."""
    along = F.struct(F.col(value).alias("a"), of_column(df, order[0]).alias("b"))
    ranked = counted(global_rank(df, along, [value, *order], "_r", by), by or [], "_n")
    edge = sum(((F.col("_r") > 1 + k * (F.col("_n") - 1) / bins).cast("int") for k in range(1, bins)), F.lit(0))
    return ranked.withColumn("bin", edge).drop("_r", "_n")


def ema(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.02) -> DataFrame:
    """Exponential moving average in order: keys, order, ema. It starts at the first value; from a null on it is null.

    A value's weight falls by 1 - alpha a row, so inside a block of rows in which weights stay above 1e-6 the average is a
    prefix sum of values over their weights. What a block hands on is worth 1e-6 of itself a block later, so a row needs the
    ends of the last 54 blocks, whose weights reach down to the least double: no list of a group, and no fold over it.
    """
    import math

    left = 1 - alpha
    length = max(1, int(math.log(1e-6) / math.log(left))) if 0 < left < 1 else 1 << 40 if left == 1 else 1
    whole = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, F.col(value).cast("double").alias("_x"), (F.row_number().over(whole) - 1).alias("_t"))
    rows = rows.select("*", F.floor(F.col("_t") / length).alias("_b"), (F.col("_t") % length).cast("double").alias("_i"))
    rows = rows.withColumn("_null", F.max(F.col("_x").isNull()).over(whole))
    share = F.when(F.col("_t") == 0, 1.0).otherwise(alpha)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(F.col("_x") * share * F.pow(F.lit(left), -F.col("_i"))).over(inside) * F.pow(F.lit(left), F.col("_i")))
    ends = rows.filter(F.col("_i") == length - 1).select(*keys, "_b", "_own")
    back = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-53, 0)
    fold = F.aggregate(F.collect_list("_own").over(back), F.lit(0.0), lambda acc, x: acc * left**length + x)
    handed = ends.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.col("_b") + 1).alias("_to"), fold.alias("_handed"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_b") == F.col("_to"))
    both = rows.join(handed, same, "left")
    at = F.col("_own") + F.coalesce(F.col("_handed"), F.lit(0.0)) * F.pow(F.lit(left), F.col("_i") + 1)
    return both.select(*keys, order, F.when(~F.col("_null"), at).alias("ema"))
