"""Queries over incremental operators (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import shared_dir
from ..operators import history as H
from ..sources.fixtures import EV, tx_events
from ..streaming import groups as G
from ..streaming import replay as R
from .q_history import _DAILY, past
from .registry import query

_TWIN = f"WITH {EV} SELECT tx_id, ts::DATE::VARCHAR AS day, count(*) OVER {_DAILY} AS degree, round(coalesce(avg(amount) OVER {_DAILY}, 0), 9) AS mean FROM ev"


@query("str1_daily_replay", _TWIN, 9)
def _(spark, d):
    return R.replay(spark, tx_events(spark, d), "user_key", shared_dir(spark))


@query("str1_batch_twin", _TWIN, 9)
def _(spark, d):
    return R.batch_twin(tx_events(spark, d), "user_key")


@query("str2_keyed_state", f"WITH {EV} SELECT user_key, count(*) AS n, round(sum(amount), 4) AS total FROM ev GROUP BY ALL")
def _(spark, d):
    import uuid

    home = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    tx_events(spark, d).select("user_key", "amount").write.parquet(f"{home}/in")
    stream = R.keyed_state(spark.readStream.schema("user_key long, amount double").parquet(f"{home}/in"), "user_key")

    def last(batch, k):  # noqa: ANN001, ANN202
        batch.withColumn("k", F.lit(k)).write.mode("append").parquet(f"{home}/out")

    stream.writeStream.outputMode("update").foreachBatch(last).option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(f"{home}/out").groupBy("user_key").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return latest.select("user_key", "x.n", F.round("x.total", 4).alias("total"))


_END = "(SELECT min(ts)::DATE + 20 FROM ev)"


@query("str3_late_rows", f"WITH {EV} SELECT (ts::DATE <= {_END})::INT AS late, count(*) AS rows FROM ev GROUP BY ALL")
def _(spark, d):
    e = tx_events(spark, d)
    end = str(e.agg(F.date_add(F.to_date(F.min("ts")), 20)).first()[0])
    on_time, late = R.split_late(e, end)
    return on_time.agg(F.lit(0).alias("late"), F.count("*").alias("rows")).union(late.agg(F.lit(1).alias("late"), F.count("*").alias("rows")))


@query("str4_tumbling_day", f"WITH {EV} SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS rows, sum(label)::BIGINT AS fraud FROM ev GROUP BY ALL")
def _(spark, d):
    return R.tumbling(tx_events(spark, d))


@query("str5_day_records", f"WITH {EV} SELECT ts::DATE::VARCHAR AS day, count(*) AS rows, count(DISTINCT user_key) AS users, min(ts) AS min_ts, max(ts) AS max_ts, 1 AS no_future FROM ev GROUP BY ALL")
def _(spark, d):
    return R.day_records(tx_events(spark, d)).drop("digest")


@query("str6_group_carry", f"WITH {EV} SELECT tx_id, row_number() OVER w AS place, sec - lag(sec) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY user_key ORDER BY sec, tx_id)")
def _(spark, d):
    return G.carried(tx_events(spark, d), "user_key")


@query("str7_sliding_counts", f"WITH {EV} SELECT tx_id, " + ", ".join(f"count(*) OVER {past('user_key', n)} AS n_{a}" for a, n in (("1h", 3600), ("24h", 86400), ("7d", 604800))) + " FROM ev")
def _(spark, d):
    p = H.Past("user_key")
    return tx_events(spark, d).select("tx_id", *(p.count(last=n).alias(f"n_{a}") for a, n in (("1h", H.HOUR), ("24h", H.DAY), ("7d", H.WEEK))))


@query("str8_session_gap", f"WITH {EV}, s AS (SELECT user_key, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY user_key ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_key, min(ts) AS start, count(*) AS rows FROM g GROUP BY user_key, k")
def _(spark, d):
    return R.sessions(tx_events(spark, d), "user_key", "1 day")
