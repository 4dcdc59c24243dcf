"""Daily causal replay: a day is scored with the history before it and then joins the history.

Batch and stream agree: replay() runs the days of a table through Structured Streaming in the calendar's order, and
batch_twin() gives the same rows by windows. State holds counts and sums only, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import SparkFiles
from ..operators.history import daily_history


def day_records(df: DataFrame) -> DataFrame:
    """day, rows, entities, max_ts, an order-free digest of the ids, and whether only the day's own times are in it."""
    digest = F.expr("bit_xor(xxhash64(tx_id))")
    day = df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"), F.countDistinct("user_key").alias("users"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), digest.alias("digest"))
    return day.withColumn("no_future", (F.to_date("min_ts") == F.to_date("max_ts")).cast("int"))


def checked_append(history_end: str | None, day: DataFrame) -> DataFrame:
    """The day, or an error if any of its rows is not newer than the history."""
    if history_end is not None and not day.filter(F.to_date("ts") <= F.lit(history_end).cast("date")).isEmpty():
        raise ValueError(f"an appended day must be newer than {history_end}")
    return day


def split_late(df: DataFrame, history_end: str) -> tuple[DataFrame, DataFrame]:
    """(rows newer than the history, late rows): in a stream late rows are diverted, not an error."""
    late = F.to_date("ts") <= F.lit(history_end).cast("date")
    return df.filter(~late), df.filter(late)


def batch_twin(df: DataFrame, key: str) -> DataFrame:
    """tx_id, day, degree, mean of the entity's history at the start of the day."""
    return daily_history(df, key, "h").select("tx_id", "day", F.col("h_degree").alias("degree"), F.col("h_mean").alias("mean"))


def scored_days(today: DataFrame, known: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of several days with the history before each row's day, the history with these days).

    known: key, n, s of the days before; a row's own day never counts.
    """
    by_day = today.groupBy(key, "day").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    frame = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n, s = (F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in "ns")
    before = by_day.select(key, "day", n.alias("n"), s.alias("s"))
    if known is not None:
        old = known.select(F.col(key).alias("_key"), F.col("n").alias("_n"), F.col("s").alias("_s"))
        joined = before.join(old, before[key].eqNullSafe(F.col("_key")), "left")
        before = joined.select(key, "day", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("s") + F.coalesce("_s", F.lit(0.0))).alias("s"))
    before = before.select(F.col(key).alias("_key"), F.col("day").alias("_day"), "n", "s")
    rows = today.join(before, today[key].eqNullSafe(F.col("_key")) & (today["day"] == F.col("_day")))
    scored = rows.select("tx_id", "day", F.col("n").alias("degree"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("mean"))
    fresh = by_day.select(key, "n", "s")
    both = fresh if known is None else known.unionByName(fresh)
    return scored, both.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def replay(spark: SparkSession, df: DataFrame, key: str, home: str, run: str | None = None, days_in_batch: int = 64, after: Callable[[int], None] | None = None) -> DataFrame:
    """batch_twin() by a stream: a micro-batch scores some days against the history before them, then adds them to it.

    The order of days is the calendar's and not the source's: micro-batch k takes the k-th run of days from a list that is
    fixed when the replay begins, and the stream's source only says when (one small file a micro-batch). So it doesn't
    matter how the rows are dealt to files and tasks, and a day may have any number of files.

    The history is a table for each micro-batch, as are the scored rows, and both are overwritten if a micro-batch comes
    again, so a replay that was ended goes on where it stopped when it is called with the same run, and no row is written twice.
    A micro-batch whose days are not newer than the history is an error. after(k) is called when micro-batch k is written.
    """
    base = f"{home}/replay-{run or uuid.uuid4().hex}"
    store = SparkFiles(spark)
    rows = df.select("tx_id", "ts", key, "amount", F.to_date("ts").alias("day"))
    if not store.exists(f"{base}/days/_SUCCESS"):
        rows.repartition("day", F.pmod(F.xxhash64("tx_id"), F.lit(8))).write.mode("overwrite").partitionBy("day").parquet(f"{base}/days")
    shape = rows.schema
    stored = lambda: spark.read.schema(shape).parquet(f"{base}/days")
    days = [str(r["day"]) for r in stored().select("day").distinct().orderBy("day").collect()]  # as many as the calendar has
    parts = [days[i : i + days_in_batch] for i in range(0, len(days), days_in_batch)]
    state, kind = f"{base}/state", f"{key} {dict(rows.dtypes)[key]}, n long, s double"
    for k in range(len(parts)):
        if not store.exists(f"{base}/ticks/{k:09d}"):
            store.create(f"{base}/ticks/{k:09d}", b"%d\n" % k)
    if not parts:
        return spark.createDataFrame([], "tx_id long, day date, degree long, mean double")

    def step(_: DataFrame, k: int) -> None:
        today = stored().filter(F.col("day").between(F.lit(parts[k][0]).cast("date"), F.lit(parts[k][-1]).cast("date")))
        known = spark.read.schema(kind).parquet(f"{state}/{k - 1}") if k else None
        scored, new = scored_days(checked_append(parts[k - 1][-1] if k else None, today), known, key)
        scored.write.mode("overwrite").parquet(f"{base}/scored/batch={k}")
        new.write.mode("overwrite").parquet(f"{state}/{k}")
        if k > 1:
            store.remove(f"{state}/{k - 2}")
        if after:
            after(k)

    ticks = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{base}/ticks")
    query = ticks.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/scored").drop("batch")


def keyed_state(stream: DataFrame, key: str) -> DataFrame:
    """key, n, total of each entity so far: a stateful aggregate whose state is two numbers for an entity."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def tumbling(df: DataFrame, width: str = "1 day") -> DataFrame:
    """start, rows, fraud of each tumbling window; on a stream, after withWatermark("ts", ...)."""
    return df.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "rows", "fraud")


def sliding(df: DataFrame, width: str, step: str) -> DataFrame:
    return df.groupBy(F.window("ts", width, step).alias("w"), "channel").agg(F.count("*").alias("rows")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "channel", "rows")


def sessions(df: DataFrame, key: str, gap: str = "7 days") -> DataFrame:
    """key, start, rows of sessions; a gap of exactly `gap` begins a new one here, as windows are half open."""
    return df.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("rows")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "rows")
