"""Queries over joins, set operations, sorts and limits (JOI, SET, SRT, LIM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import splits as S
from ..sources.fixtures import EV, SCORED, TX, U, scored, table, transactions, tx_events, uniform
from .registry import query

_RUNS = f"{SCORED}, ra AS (SELECT tx_id, label, score FROM sc), rb AS (SELECT tx_id, label, floor({U.format("'5|' || tx_id")} * 100) / 100.0::DOUBLE AS score FROM tx)"


def runs(spark, d, whole=True):  # noqa: ANN001, ANN201
    """Runs A and B over all rows; without `whole`, B is a run that covers a third of them (for tests of unpaired rows)."""
    a = scored(transactions(spark, d)).select("tx_id", "label", "score")
    b = transactions(spark, d).filter("true" if whole else "tx_id % 3 = 0").select("tx_id", "label", (F.floor(uniform(5, "tx_id") * 100) / 100.0).alias("score"))
    return a, b


@query("joi1_paired_predictions", f"WITH {_RUNS} SELECT ra.tx_id, ra.label AS label_a, ra.score AS score_a, rb.label AS label_b, rb.score AS score_b FROM ra JOIN rb USING (tx_id)")
def _(spark, d):
    return R.paired(*runs(spark, d), "tx_id")


@query("joi2_left_degrees", f"WITH {_RUNS}, g AS (SELECT merchant_key, count(*) AS degree FROM tx WHERE ts < TIMESTAMP '1996-01-01' GROUP BY ALL) SELECT tx_id, degree FROM tx LEFT JOIN g USING (merchant_key)")
def _(spark, d):
    t = transactions(spark, d)
    g = t.filter("ts < TIMESTAMP_NTZ '1996-01-01 00:00:00'").groupBy("merchant_key").agg(F.count("*").alias("degree"))
    return t.join(g, "merchant_key", "left").select("tx_id", "degree")


@query("joi3_full_domain", f"WITH {TX}, c AS (SELECT channel, city_key, count(*) AS n FROM tx WHERE amount < -20000 GROUP BY ALL) SELECT x.channel, x.city_key, coalesce(c.n, 0) AS n FROM (SELECT channel, n_name AS city_key FROM (SELECT DISTINCT channel FROM tx), nation) x LEFT JOIN c ON c.channel = x.channel AND c.city_key = x.city_key")
def _(spark, d):
    t = transactions(spark, d)
    domain = t.select("channel").distinct().crossJoin(F.broadcast(table(spark, d, "nation").select(F.col("n_name").alias("city_key"))))
    return R.on_domain(t.filter("amount < -20000").groupBy("channel", "city_key").agg(F.count("*").alias("n")), domain, ["channel", "city_key"])


@query("joi4_chained_self_join", f"WITH {TX}, {', '.join(f"c{c} AS (SELECT user_key, count(*) AS n, round(sum(amount), 4) AS amount FROM tx WHERE channel = '{c}' GROUP BY user_key)" for c in 'FOP')} SELECT user_key, cF.n AS n_F, cF.amount AS amount_F, cO.n AS n_O, cO.amount AS amount_O, cP.n AS n_P, cP.amount AS amount_P FROM cF JOIN cO USING (user_key) JOIN cP USING (user_key)")
def _(spark, d):
    t = transactions(spark, d)
    return R.chained([(c, t.filter(F.col("channel") == c).groupBy("user_key").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount"))) for c in "FOP"], "user_key")


@query("joi5_dictionary_lookup", f"WITH {TX} SELECT tx_id, coalesce(n_regionkey, -1)::INT AS n_regionkey FROM tx LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON n_name = city_key")
def _(spark, d):
    t = table(spark, d, "nation").filter("n_nationkey < 12").select(F.col("n_name").alias("city_key"), "n_regionkey")
    return R.lookup(transactions(spark, d), t, "city_key", "n_regionkey", -1).select("tx_id", "n_regionkey")


_TARGET = f"{EV}, t AS (SELECT * FROM ev WHERE ts::DATE = (SELECT max(ts)::DATE FROM ev)), h AS (SELECT * FROM ev WHERE ts::DATE < (SELECT max(ts)::DATE FROM ev))"


def _target(spark, d):  # noqa: ANN001, ANN202
    e = tx_events(spark, d)
    last = F.broadcast(e.agg(F.to_date(F.max("ts")).alias("_d")))
    j = e.crossJoin(last)
    return j.filter(F.to_date("ts") == F.col("_d")).drop("_d"), j.filter(F.to_date("ts") < F.col("_d")).drop("_d")


@query("joi6_semi_join", f"WITH {_TARGET} SELECT tx_id, user_key FROM h WHERE user_key IN (SELECT user_key FROM t)")
def _(spark, d):
    t, h = _target(spark, d)
    return R.members(h, t, ["user_key"]).select("tx_id", "user_key")


@query("joi7_anti_join", f"WITH {_TARGET} SELECT tx_id, user_key FROM h WHERE user_key NOT IN (SELECT user_key FROM t)")
def _(spark, d):
    t, h = _target(spark, d)
    return R.members(h, t, ["user_key"], absent=True).select("tx_id", "user_key")


@query("joi8_composite_lookup", f"WITH {TX}, p AS (SELECT user_key, merchant_key, min(tx_id) AS first_tx FROM tx GROUP BY ALL) SELECT tx_id, first_tx FROM tx JOIN p USING (user_key, merchant_key)")
def _(spark, d):
    t = transactions(spark, d)
    p = t.groupBy("user_key", "merchant_key").agg(F.min("tx_id").alias("first_tx"))
    return t.join(p, ["user_key", "merchant_key"]).select("tx_id", "first_tx")


@query("joi9_interval_join", f"WITH {TX}, w(win, a, b) AS (VALUES (1, DATE '1996-01-01', DATE '1997-01-01'), (2, DATE '1996-07-01', DATE '1997-07-01')) SELECT tx_id, win FROM tx JOIN w ON ts >= a AND ts < b")
def _(spark, d):
    w = spark.sql("SELECT * FROM VALUES (1, DATE '1996-01-01', DATE '1997-01-01'), (2, DATE '1996-07-01', DATE '1997-07-01') AS w(win, start, end)")
    return S.by_window(transactions(spark, d), w).select("tx_id", "win")


@query("joi10_previous_event", f"WITH {EV} SELECT tx_id, max(ts) OVER w AS previous_ts, arg_max(amount, sec * 10000000 + tx_id) OVER w AS previous_amount FROM ev WINDOW w AS (PARTITION BY user_key ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_key").orderBy("sec").rangeBetween(Window.unboundedPreceding, -1)
    return tx_events(spark, d).select("tx_id", F.max("ts").over(w).alias("previous_ts"), F.max_by("amount", F.struct("sec", "tx_id")).over(w).alias("previous_amount"))


@query("joi11_cross_product", "SELECT r_name AS strategy, seed::INT AS seed, win::INT AS win FROM region, range(1, 6) s(seed), range(1, 4) w(win)")
def _(spark, d):
    one = lambda n, name: spark.range(1, n).select(F.col("id").cast("int").alias(name))
    return table(spark, d, "region").select(F.col("r_name").alias("strategy")).crossJoin(F.broadcast(one(6, "seed"))).crossJoin(F.broadcast(one(4, "win")))


@query("joi12_method_pairs", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def _(spark, d):
    return R.pairs_of(table(spark, d, "region"), "r_name")


@query("joi13_gather", f"WITH {TX} SELECT tx_id, amount FROM tx WHERE tx_id IN (SELECT event_id * 3 FROM events)")
def _(spark, d):
    ids = table(spark, d, "events").select((F.col("event_id") * 3).alias("tx_id"))
    return transactions(spark, d).join(ids, "tx_id", "left_semi").select("tx_id", "amount")


@query("set1_union_all", f"WITH {EV} SELECT tx_id, channel FROM ev WHERE user_key % 2 = 0 UNION ALL SELECT tx_id, channel FROM ev WHERE merchant_key % 2 = 0")
def _(spark, d):
    e = tx_events(spark, d)
    return e.filter("user_key % 2 = 0").select("tx_id", "channel").unionByName(e.filter("merchant_key % 2 = 0").select("channel", "tx_id"))


@query("set2_union_distinct", f"WITH {EV} SELECT tx_id FROM ev WHERE user_key % 2 = 0 UNION SELECT tx_id FROM ev WHERE merchant_key % 2 = 0")
def _(spark, d):
    e = tx_events(spark, d)
    return e.filter("user_key % 2 = 0").select("tx_id").union(e.filter("merchant_key % 2 = 0").select("tx_id")).distinct()


@query("set3_intersect", f"WITH {EV} SELECT count(*) AS shared FROM (SELECT user_key FROM ev WHERE channel = 'error' INTERSECT SELECT user_key FROM ev WHERE amount > 50)")
def _(spark, d):
    e = tx_events(spark, d)
    return e.filter("channel = 'error'").select("user_key").intersect(e.filter("amount > 50").select("user_key")).agg(F.count("*").alias("shared"))


@query("set4_except", f"WITH {EV} SELECT user_key FROM ev EXCEPT SELECT user_key FROM ev WHERE channel = 'error'")
def _(spark, d):
    e = tx_events(spark, d)
    return e.select("user_key").distinct().exceptAll(e.filter("channel = 'error'").select("user_key").distinct())


@query("set5_first_seen_distinct", f"WITH {TX} SELECT merchant_key, min(tx_id) AS first_seen FROM tx GROUP BY ALL")
def _(spark, d):
    return R.first_seen(transactions(spark, d), "merchant_key")


@query("set6_keep_last", f"WITH {EV} SELECT user_key, channel, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY user_key, channel ORDER BY ts DESC, tx_id DESC) AS r FROM ev) WHERE r = 1")
def _(spark, d):
    return R.keep_last(tx_events(spark, d), ["user_key", "channel"], [F.col("ts").desc(), F.col("tx_id").desc()]).select("user_key", "channel", "tx_id")


@query("srt1_chronological", f"WITH {TX} SELECT tx_id, ts, user_key FROM tx ORDER BY ts, tx_id")
def _(spark, d):
    return transactions(spark, d).select("tx_id", "ts", "user_key").orderBy("ts", "tx_id")


@query("srt2_external_sort", f"WITH {TX} SELECT amount, tx_id FROM tx ORDER BY amount, tx_id")
def _(spark, d):
    return transactions(spark, d).select("amount", "tx_id").orderBy("amount", "tx_id")  # spills by itself


@query("srt3_group_contiguous", f"WITH {TX} SELECT user_key, ts, tx_id FROM tx")
def _(spark, d):
    return R.clustered(transactions(spark, d).select("user_key", "ts", "tx_id"), ["user_key"], ["ts", "tx_id"])


@query("srt4_natural_key", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 97, p_partkey) AS place FROM part")
def _(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("run"), (F.col("p_partkey") % 97).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    return p.select("p_partkey", F.row_number().over(Window.orderBy(R.natural_key(F.col("name")))).cast("long").alias("place"))


@query("lim1_top_k", f"WITH {SCORED} SELECT tx_id, score FROM sc ORDER BY score DESC, tx_id LIMIT 100")
def _(spark, d):
    return R.top_k(scored(transactions(spark, d)).select("tx_id", "score"), 100, [F.col("score").desc(), F.col("tx_id")])


@query("lim2_top_k_per_group", f"WITH {SCORED} SELECT channel, tx_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, tx_id) AS r FROM sc) WHERE r <= 20")
def _(spark, d):
    return R.top_k_per_group(scored(transactions(spark, d)), ["channel"], [F.col("score").desc(), F.col("tx_id")], 20).select("channel", "tx_id", "rank")


@query("lim3_first_cases", f"WITH {SCORED} SELECT state_key, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY score, tx_id) AS r FROM sc) WHERE r <= 250")
def _(spark, d):
    return R.top_k_per_group(scored(transactions(spark, d)), ["state_key"], [F.col("score"), F.col("tx_id")], 250).select("state_key", "tx_id")


@query("lim4_argmax_row", f"WITH {EV} SELECT channel, tx_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY amount DESC NULLS LAST, tx_id) AS r FROM ev) WHERE r = 1")
def _(spark, d):
    return R.argmax(tx_events(spark, d), ["channel"], "amount", "tx_id").select("channel", "tx_id", "amount")


@query("lim5_prefix", f"WITH {TX} SELECT tx_id, user_key FROM tx ORDER BY tx_id LIMIT 500")
def _(spark, d):
    return transactions(spark, d).select("tx_id", "user_key").orderBy("tx_id").limit(500)
