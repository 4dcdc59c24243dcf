"""Ranks over whole tables without a task that holds the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a draw in [0, 1); numbers that share a bucket of a key.
BUCKETS = 1 << 16


def of_draw(u: Column) -> Column:
    """The bucket of a draw in [0, 1)."""
    return F.floor(u * BUCKETS)


def of_key(key: Column | str) -> Column:
    """The bucket of a whole number."""
    return F.floor((F.col(key) if isinstance(key, str) else key) / BUCKETS)


def of_column(df: DataFrame, column: str) -> Column:
    """The bucket of a column by its kind: runs of whole numbers, days of times, other values as they are."""
    kind = dict(df.dtypes)[column]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return of_key(column)
    return F.to_date(column) if kind.startswith("timestamp") else F.col(column)


def counted(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the rows of its group, from partial counts."""
    counts = df.groupBy(*(F.col(c).alias(f"_of_{c}") for c in by)).agg(F.count("*").alias(name))
    if not by:
        return df.crossJoin(F.broadcast(counts))
    same = F.col(by[0]).eqNullSafe(F.col(f"_of_{by[0]}"))
    for c in by[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(counts, same).select(*df.columns, name)


def global_rank(df: DataFrame, bucket: Column, order: list[Column | str], name: str, by: list[str] | None = None) -> DataFrame:
    """df with its rank 1.. (in each group of by) in `order`; bucket: a number, or a struct, that never falls along that order.

    The rank is the rank inside the bucket plus the rows of lower buckets. A task holds a bucket, or one row for each bucket.
    """
    by = by or []
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_below"))
    ranked = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return ranked.join(below, same).select(*df.columns, (F.col("_below") + F.col("_inside")).alias(name))
