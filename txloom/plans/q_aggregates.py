"""Queries over aggregations (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import splits as S
from ..sources.fixtures import EV, SCORED, TX, scored, table, transactions, tx_events
from .q_history import _EPISODES
from .q_projections import _SPLIT
from .q_splits import _FOLDS, FOLDS
from .registry import query

MONTH = "strftime(ts, '%Y-%m')"


@query("agg1_monthly_support", f"WITH {TX} SELECT {MONTH} AS month, channel, count(*) AS rows, sum(label)::BIGINT AS fraud, count(DISTINCT user_key) FILTER (label = 1) AS fraud_users, count(DISTINCT (user_key, card_key)) FILTER (label = 1) AS fraud_cards FROM tx GROUP BY ALL")
def _(spark, d):
    return A.monthly_support(transactions(spark, d))


@query("agg2_monthly_episodes", f"WITH {_EPISODES} SELECT {MONTH} AS month, channel, sum(episode_start)::BIGINT AS episodes FROM ep GROUP BY ALL")
def _(spark, d):
    return A.monthly_episodes(transactions(spark, d))


@query("agg3_fold_role_support", f"WITH {TX}, {_FOLDS} SELECT fold, role, count(*) AS rows, sum(label)::BIGINT AS fraud, count(DISTINCT user_key) AS users, count(DISTINCT (user_key, card_key)) FILTER (label = 1) AS fraud_cards FROM f JOIN tx ON ts >= a AND ts < b GROUP BY ALL")
def _(spark, d):
    return A.fold_role_support(transactions(spark, d), S.calendar_folds(FOLDS, spark))


@query("agg4_file_audit", f"WITH {TX} SELECT count(*) AS rows, sum(label)::BIGINT AS fraud, count(DISTINCT (user_key, card_key)) AS clients, count(DISTINCT merchant_key) AS merchants, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (errors_key IS NULL) AS errors_key_null, count(*) FILTER (amount IS NULL) AS amount_null FROM tx")
def _(spark, d):
    return A.file_audit(transactions(spark, d), ["errors_key", "amount"])


@query("agg4_daily", f"WITH {TX} SELECT ts::DATE::VARCHAR AS day, count(*) AS rows, sum(label)::BIGINT AS fraud FROM tx GROUP BY ALL")
def _(spark, d):
    return S.daily_counts(transactions(spark, d))


@query("agg5_class_counts", f"WITH {_SPLIT} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, split, label, {f} AS value, count(*) AS rows FROM s GROUP BY ALL" for f in ("channel", "mcc", "state_key")))
def _(spark, d):
    return A.class_counts(S.tie_safe_split(transactions(spark, d)), ["channel", "mcc", "state_key"], ["split"])


@query("agg6_composition", f"WITH {_SPLIT} SELECT split, channel, count(*) AS rows, sum(label)::BIGINT AS fraud FROM s GROUP BY ALL")
def _(spark, d):
    return A.composition(S.tie_safe_split(transactions(spark, d)), "split")


@query("agg7_quantile_profile", f"WITH {EV} SELECT channel, count(amount) AS count, round(avg(amount), 6) AS mean, round(stddev_pop(amount), 6) AS std, min(amount) AS min, " + ", ".join(f"round(quantile_cont(amount, {q}), 6) AS {n}" for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", max(amount) AS max FROM ev GROUP BY channel")
def _(spark, d):
    return M.quantile_profile(tx_events(spark, d), "amount", ["channel"])


@query("agg8_score_diagnostics", f"WITH {SCORED}, p AS (SELECT score, 'all' AS part FROM sc UNION ALL SELECT score, CASE WHEN label = 1 THEN 'fraud' ELSE 'normal' END FROM sc) SELECT part, count(*) AS rows, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.05), 6) AS q05, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS q95, round(avg((score <= 0.01 OR score >= 0.99)::INT), 6) AS saturated FROM p GROUP BY part")
def _(spark, d):
    return A.score_diagnostics(scored(transactions(spark, d)))


@query("agg9_metric_summary", f"WITH {EV} SELECT channel, user_key % 5 AS method, count(amount) AS count, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, round(quantile_cont(amount, 0.5), 6) AS median FROM ev GROUP BY ALL")
def _(spark, d):
    long = tx_events(spark, d).select("channel", (F.col("user_key") % 5).alias("method"), F.col("amount").alias("value"))
    return A.metric_summary(long, ["channel", "method"])


@query("agg10_named_summary", f"WITH {EV} SELECT channel, count(DISTINCT user_key) AS seeds, count(*) AS runs, round(avg(amount), 6) AS mean FROM ev GROUP BY channel")
def _(spark, d):
    return tx_events(spark, d).groupBy("channel").agg(F.countDistinct("user_key").alias("seeds"), F.count("*").alias("runs"), F.avg("amount").alias("mean"))


@query("agg11_best_by", f"WITH {EV} SELECT channel, count(amount) AS count, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, max(amount) AS max, (SELECT e.tx_id FROM ev e WHERE e.channel = ev.channel ORDER BY amount DESC, tx_id LIMIT 1) AS best FROM ev GROUP BY channel")
def _(spark, d):
    return A.best_by(tx_events(spark, d), ["channel"], "amount", "tx_id")


@query("agg12_metric_catalog", f"WITH {TX} SELECT 'errors_key' AS metric, count(*) AS recorded, count(errors_key) AS available FROM tx UNION ALL SELECT 'amount', count(*), count(amount) FROM tx")
def _(spark, d):
    return A.catalog(transactions(spark, d), ["errors_key", "amount"])


@query("agg13_pivot", f"WITH {TX} SELECT state_key, " + ", ".join(f"nullif(count(*) FILTER (channel = '{c}'), 0) AS \"{c}\"" for c in "FOP") + " FROM tx GROUP BY state_key")
def _(spark, d):
    return A.pivoted(transactions(spark, d), "state_key", "channel", list("FOP"), F.count(F.lit(1)))


@query("agg14_melt", "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return A.molten(s, ["s_suppkey"], ["balance", "nation"])


@query("agg15_weighted", f"WITH {EV}, w AS (SELECT channel, amount, user_key % 3 + 1 AS w FROM ev), r AS (SELECT channel, amount FROM w, range(3) g(i) WHERE i < w) SELECT channel, round(avg(amount), 6) AS mean, round(quantile_cont(amount, 0.5), 6) AS median FROM r GROUP BY channel")
def _(spark, d):
    e = tx_events(spark, d).withColumn("w", F.col("user_key") % 3 + 1)
    return A.weighted(e, ["channel"], "amount", "w")


@query("agg16_geometric_mean", f"WITH {EV} SELECT channel, round(exp(avg(ln(greatest(amount, 1e-6)))), 6) AS x FROM ev GROUP BY channel")
def _(spark, d):
    return tx_events(spark, d).groupBy("channel").agg(A.geometric_mean(F.col("amount")).alias("x"))


@query("agg17_mode_median", f"WITH {TX}, c AS (SELECT state_key, mcc, count(*) AS n FROM tx GROUP BY ALL), m AS (SELECT state_key, mcc AS mode FROM (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY n DESC, mcc) AS r FROM c) WHERE r = 1) SELECT state_key, mode, round(quantile_cont(amount, 0.5), 4) AS median FROM tx JOIN m USING (state_key) GROUP BY ALL")
def _(spark, d):
    return A.modes(transactions(spark, d), ["state_key"], "mcc", "amount").withColumn("median", F.round("median", 4))


@query("agg18_class_scatter", "SELECT label, count(*) AS rows, round(sum(embedding[1]::DOUBLE), 4) AS first_sum, round(sum(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS squares FROM embeddings GROUP BY label")
def _(spark, d):
    s = A.scatter(table(spark, d, "embeddings"), "embedding", "label", 64)
    return s.select("label", "rows", F.round(F.col("sums")[0], 4).alias("first_sum"), F.round("squares", 4).alias("squares"))


@query("agg19_histogram_2d", f"WITH {SCORED} SELECT {MONTH} AS a, floor(score * 10)::BIGINT AS b, count(*) AS rows, sum(label)::BIGINT AS fraud FROM sc GROUP BY ALL")
def _(spark, d):
    return A.histogram_2d(scored(transactions(spark, d)), A.month(), F.floor(F.col("score") * 10))


@query("agg20_fanout_comparison", f"WITH {EV}, l AS (SELECT user_key, channel, amount AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_key, channel ORDER BY ts DESC, tx_id DESC) AS r FROM ev) WHERE r = 1) SELECT channel, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM l GROUP BY channel")
def _(spark, d):
    runs = tx_events(spark, d).withColumn("value", F.col("amount"))
    return A.latest_then_summary(runs, ["user_key", "channel"], [F.col("ts").desc(), F.col("tx_id").desc()], ["channel"])
