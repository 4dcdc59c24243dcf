"""Joins, set operations, sorts and limits with the reference's rules: total orders, null-safe keys, explicit tie-breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join of two tables with the same columns; fails if a key repeats on either side."""
    for side in (a, b):
        if not side.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} repeats")
    left, right = (d.select(key, *(F.col(c).alias(c + s) for c in d.columns if c != key)) for d, s in zip((a, b), suffixes, strict=True))
    return left.join(right, key)


def on_domain(df: DataFrame, domain: DataFrame, keys: list[str], fill: int = 0) -> DataFrame:
    """Every row of a small domain with the matching columns of df, or fill."""
    rest = [c for c in df.columns if c not in keys]
    return domain.join(df, keys, "left").select(*keys, *(F.coalesce(c, F.lit(fill)).alias(c) for c in rest))


def chained(frames: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """N tables side by side on a key; their other columns get the table's name."""
    named = [d.select(key, *(F.col(c).alias(f"{c}_{n}") for c in d.columns if c != key)) for n, d in frames]
    return reduce(lambda a, b: a.join(b, key), named)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """A dictionary lookup: a left join on the key; default where it is not in the table."""
    t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(t, df[key].eqNullSafe(t["_k"]), "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def members(df: DataFrame, other: DataFrame, keys: list[str], absent: bool = False) -> DataFrame:
    """Rows whose keys are (or are not) in the other table."""
    return df.join(other.select(*keys), keys, "left_anti" if absent else "left_semi")


def pairs_of(methods: DataFrame, name: str) -> DataFrame:
    """All pairs (a, b) of a small table's distinct names, a before b."""
    d = methods.select(name).distinct()
    return d.select(F.col(name).alias("a")).join(d.select(F.col(name).alias("b")), F.col("a") < F.col("b"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def first_seen(df: DataFrame, key: str, order: str = "tx_id") -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen"))


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark keeps k rows of each group per task before the exchange."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def argmax(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each group; ties: the least `tie`."""
    return top_k_per_group(df, keys, [F.col(value).desc_nulls_last(), F.col(tie)], 1, "_k").drop("_k")


def natural_key(c: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers of up to `width` digits."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.concat_ws("", F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, width, "0")).otherwise(F.lower(x))))


def clustered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's rows together in one partition and in order, without a global sort."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)
