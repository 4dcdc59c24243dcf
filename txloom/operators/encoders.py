"""Encoders fitted on training rows only. A fit is a small table (one row, or one row for each value) that a join applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import clip, signed_log

PI = 3.141592653589793


def _apply(df: DataFrame, fit: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(fit))


def minmax(train: DataFrame, df: DataFrame, column: str, out: str, clipped: bool = False) -> DataFrame:
    """Median for missing values, then (x - min) / range of the training rows; a range of 0 counts as 1."""
    fit = train.agg(F.percentile(column, 0.5).alias("_m"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = (F.coalesce(column, "_m") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    x = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) if clipped else x
    return _apply(df, fit).withColumn(out, x).drop("_m", "_lo", "_hi")


def robust(train: DataFrame, df: DataFrame, column: str, out: str, most: float = 10) -> DataFrame:
    """Signed log, centred at the training median over the quartile range, clipped; 0 where missing."""
    x = signed_log(column)
    fit = train.agg(F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("_q"))
    spread = F.col("_q")[2] - F.col("_q")[0]
    z = (F.coalesce(x, F.col("_q")[1]) - F.col("_q")[1]) / F.when(spread > 0, spread).otherwise(1.0)
    return _apply(df, fit).withColumn(out, clip(z, most)).drop("_q")


def standard(train: DataFrame, df: DataFrame, column: str | Column, out: str) -> DataFrame:
    """(x - mean) / population deviation of the training rows; a deviation of 0 counts as 1."""
    c = F.col(column) if isinstance(column, str) else column
    fit = train.agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"))
    return _apply(df, fit).withColumn(out, (c - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def _join_codes(df: DataFrame, codes: DataFrame, column: str, out: str, default: object) -> DataFrame:
    return df.join(codes.withColumnRenamed(column, "_k"), F.col(column).eqNullSafe(F.col("_k")), "left").withColumn(out, F.coalesce(out, F.lit(default))).drop("_k")


def ordinal(train: DataFrame, df: DataFrame, column: str, out: str) -> DataFrame:
    """Sorted training values are 1..K, others 0."""
    codes = train.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)))
    return _join_codes(df, codes, column, out, 0)


def first_appearance(train: DataFrame, df: DataFrame, column: str, out: str, order: str = "tx_id") -> DataFrame:
    """Codes 0..K-1 by first appearance over K; unseen values take the training mode's code (of equal counts the least value's)."""
    seen = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_f"), F.count("*").alias("_n"))
    codes = seen.withColumn(out, (F.row_number().over(Window.orderBy("_f")) - 1) / F.count("*").over(Window.partitionBy()))
    mode = codes.agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col(column).alias("b"), F.col(out).alias("c"))).alias("x")).select(F.col("x.c").alias("_mode"))
    j = df.join(codes.select(F.col(column).alias("_k"), out), F.col(column) == F.col("_k"), "left")
    return _apply(j, mode).withColumn(out, F.coalesce(out, "_mode")).drop("_k", "_mode")


def one_hot(train: DataFrame, df: DataFrame, column: str, most: int = 512) -> DataFrame:
    """A 0/1 column for each training value, for <oov> and for <missing>. The list of values is bounded by `most`."""
    values = sorted(r[0] for r in train.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has over {most} values")
    flags = {f"{column}={v}": F.coalesce(F.col(column) == v, F.lit(False)) for v in values}
    flags |= {f"{column}=<oov>": F.coalesce(~F.col(column).isin(values), F.lit(False)), f"{column}=<missing>": F.col(column).isNull()}
    return df.withColumns({k: c.cast("int") for k, c in flags.items()})


def frequency(train: DataFrame, df: DataFrame, column: str, out: str) -> DataFrame:
    """Share of the training rows with the value, 0 for others; out_oov flags those; out_surprisal is -ln(max(f, 1e-9)) / 20."""
    n = F.broadcast(train.agg(F.count("*").alias("_n")))
    codes = train.groupBy(column).agg(F.count("*").alias("_c")).crossJoin(n).select(column, (F.col("_c") / F.col("_n")).alias(out))
    j = _join_codes(df, codes, column, out, 0.0)
    return j.withColumns({f"{out}_oov": (F.col(out) == 0).cast("int"), f"{out}_surprisal": -F.log(F.greatest(F.col(out), F.lit(1e-9))) / 20})


def cyclic(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Sine and cosine of hour, weekday (Monday 0) and month; weekend flag."""
    parts = {"hour": ((F.hour(ts) + F.minute(ts) / 60.0), 24), "dow": (F.weekday(ts), 7), "month": (F.month(ts) - 1, 12)}
    waves = {f"{n}_{w}": f(x * (2 * PI / p)) for n, (x, p) in parts.items() for w, f in (("sin", F.sin), ("cos", F.cos))}
    return df.withColumns(waves | {"weekend": (F.weekday(ts) >= 5).cast("int")})


def flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "online": (F.col("channel") == "O").cast("int"), "has_error": F.col("errors_key").isNotNull().cast("int"),
        "refund": F.coalesce(F.col("amount") < 0, F.lit(False)).cast("int"), "amount_missing": F.col("amount").isNull().cast("int"),
    })


def log_amount(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.log1p(F.greatest(F.lit(0.0), c))


#: Feature families by mode; clean_basic drops what clean keeps besides.
FAMILIES = {"clean": ["amount", "channel", "mcc", "state_key"], "clean_basic": ["amount", "channel"]}


def family(df: DataFrame, mode: str, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    return df.select(*keep, *FAMILIES[mode])


def sparse_matrix(train: DataFrame, df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """tx_id, features: one-hot blocks that ignore unknown values, then the numbers, as sparse vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    ix, hot = [f"{c}_ix" for c in categories], [f"{c}_hot" for c in categories]
    steps = [StringIndexer(inputCols=categories, outputCols=ix, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=ix, outputCols=hot, dropLast=True), VectorAssembler(inputCols=[*hot, *numbers], outputCol="features", handleInvalid="keep")]
    return Pipeline(stages=steps).fit(train).transform(df).select("tx_id", "features")
