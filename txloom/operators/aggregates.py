"""Support tables, profiles and summaries. Count-distincts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import episodes


def month(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_support(df: DataFrame) -> DataFrame:
    """Rows, positives, and distinct positive users and cards by month and channel."""
    pos = F.col("label") == 1
    return df.groupBy(month().alias("month"), "channel").agg(
        F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"), F.countDistinct(F.when(pos, F.col("user_key"))).alias("fraud_users"),
        F.countDistinct(F.when(pos, F.struct("user_key", "card_key"))).alias("fraud_cards"),
    )


def monthly_episodes(df: DataFrame) -> DataFrame:
    return episodes(df, ["user_key", "card_key"]).groupBy(month().alias("month"), "channel").agg(F.sum("episode_start").cast("long").alias("episodes"))


def fold_role_support(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Positives, users and cards of each fold and role."""
    from .splits import by_window

    pos = F.col("label") == 1
    return by_window(df, folds).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"), F.countDistinct("user_key").alias("users"), F.countDistinct(F.when(pos, F.struct("user_key", "card_key"))).alias("fraud_cards"))


def file_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row about the whole file: rows, positives, entities, time range, nulls of each column."""
    return df.agg(
        F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"), F.countDistinct("user_key", "card_key").alias("clients"), F.countDistinct("merchant_key").alias("merchants"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_null") for c in columns),
    )


def class_counts(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """feature, by, label, value, rows: category counts of all features in one pass over an unpivot."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features)))
    return df.select(*by, "label", each.alias("e")).groupBy("e.feature", *by, "label", "e.value").agg(F.count("*").alias("rows"))


def composition(df: DataFrame, role: str) -> DataFrame:
    return df.groupBy(role, "channel").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"))


def score_diagnostics(df: DataFrame) -> DataFrame:
    """part (all, normal, fraud), mean, quantiles and the share of saturated scores."""
    parts = F.array(F.lit("all"), F.when(F.col("label") == 1, "fraud").otherwise("normal"))
    saturated = F.avg(((F.col("score") <= 0.01) | (F.col("score") >= 0.99)).cast("double"))
    return df.select("score", F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("rows"), F.avg("score").alias("mean"), *(F.percentile("score", q).alias(n) for n, q in (("q05", 0.05), ("median", 0.5), ("q95", 0.95))), saturated.alias("saturated"))


def metric_summary(long: DataFrame, by: list[str]) -> DataFrame:
    """count, mean, sample deviation and median of (by, value)."""
    return long.groupBy(*by).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", 0.5).alias("median"))


def best_by(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Count, mean, deviation, maximum, and the name with it (of equal ones the least)."""
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("max"), F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("best"))


def catalog(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, recorded, available (not null) of each column."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col("_n").alias("recorded"), F.col(c).alias("available")) for c in columns))).alias("e")).select("e.*")


def pivoted(df: DataFrame, row: str, column: str, values: list, agg: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(agg)


def molten(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def weighted(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and the median of each value repeated by its weight."""
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.percentile(value, 0.5, F.col(weight)).alias("median"))


def geometric_mean(c: Column, floor: float = 1e-6) -> Column:
    return F.exp(F.avg(F.log(F.greatest(c, F.lit(floor)))))


def modes(df: DataFrame, by: list[str], value: str, number: str) -> DataFrame:
    """mode (of equal counts the least) and median."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    mode = counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))
    return mode.join(df.groupBy(*by).agg(F.percentile(number, 0.5).alias("median")), by)


def scatter(df: DataFrame, vector: str, by: str, width: int) -> DataFrame:
    """rows, sums of each dimension and of squared norms, by class: what class scatter needs, in one pass."""
    x = lambda i: F.col(vector)[i].cast("double")
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.array(*(F.sum(x(i)) for i in range(width))).alias("sums"), F.sum(sum((x(i) * x(i) for i in range(width)), F.lit(0.0))).alias("squares"))


def histogram_2d(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"))


def latest_then_summary(runs: DataFrame, keys: list[str], order: list[Column], by: list[str]) -> DataFrame:
    """The latest run of each key, then mean and deviation of its values."""
    from .relational import keep_last

    return keep_last(runs, keys, order).groupBy(*by).agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
