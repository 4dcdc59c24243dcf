"""Queries over strictly-past behaviour (WIN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import splits as P
from ..sources.fixtures import EV, TX, chronological_id, scored, transactions, tx_events, tx_lineitem, SCORED, TIE
from .registry import query

X = "CASE WHEN isfinite(amount) THEN sign(amount) * ln(1 + abs(amount)) END"


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def past(keys: str, last: int | None = None) -> str:
    start = "UNBOUNDED PRECEDING" if last is None else f"{last} PRECEDING"
    return f"(PARTITION BY {keys} ORDER BY sec RANGE BETWEEN {start} AND 1 PRECEDING)"


def moments(keys: str, last: int | None = None) -> str:
    w = past(keys, last)
    return f"count(x) OVER {w} AS n, sum(x) OVER {w} AS s, sum(x * x) OVER {w} AS ss"


DELTA = "CASE WHEN x IS NOT NULL AND n > 0 THEN greatest(least(x - s / n, 10.0), -10.0) / 5 ELSE 0.0 END"
Z = "CASE WHEN x IS NOT NULL AND n > 0 THEN greatest(least((x - s / n) / sqrt(greatest(ss / n - (s / n) * (s / n), 0.25)), 10.0), -10.0) / 5 ELSE 0.0 END"
E_ = f"{EV}, e AS (SELECT *, {X} AS x FROM ev)"
T_ = f"{TX}, e AS (SELECT *, {X} AS x FROM tx)"


def _cols(*names):  # noqa: ANN002, ANN202
    return lambda df: df.select("tx_id", *names)


for _id, _src, _with, _key, _pre in (("win1_prior_count_log", tx_events, E_, "user_key", "user"), ("win1_prior_count_log_card", transactions, T_, "user_key, card_key", "card")):
    _keys = _key.split(", ")

    @query(_id, f"WITH {_with} SELECT tx_id, {r(f'ln(1 + count(*) OVER {past(_key)}) / 10', 'prior_count_log')} FROM e")
    def _(spark, d, src=_src, keys=_keys):  # noqa: ANN001, ANN202
        return src(spark, d).select("tx_id", H.log_scaled(H.Past(*keys).count(), 10).alias("prior_count_log"))


@query("win2_cold_start", f"WITH {E_} SELECT tx_id, (count(*) OVER {past('user_key')} = 0)::INT AS user_cold_start FROM e")
def _(spark, d):
    return H.entity_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_cold_start")


@query("win3_seconds_since_previous_log", f"WITH {E_} SELECT tx_id, {r(f'coalesce(ln(1 + sec - max(sec) OVER {past('user_key')}) / 16, 0)', 'user_since_previous_log')} FROM e")
def _(spark, d):
    return H.entity_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_since_previous_log")


@query("win4_window_counts_log", f"WITH {E_} SELECT tx_id, " + ", ".join(r(f"ln(1 + count(*) OVER {past('user_key', n)}) / 5", f"user_count_{a}_log") for a, n in (("1h", 3600), ("24h", 86400), ("7d", 604800))) + " FROM e")
def _(spark, d):
    return H.entity_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_count_1h_log", "user_count_24h_log", "user_count_7d_log")


@query("win5_amount_log_delta", f"WITH {T_}, m AS (SELECT tx_id, x, {moments('user_key')} FROM e) SELECT tx_id, {r(DELTA, 'user_amount_log_delta')} FROM m")
def _(spark, d):
    return H.entity_features(transactions(spark, d), "user_key", "user").select("tx_id", "user_amount_log_delta")


@query("win6_amount_log_z", f"WITH {T_}, m AS (SELECT tx_id, x, {moments('user_key')} FROM e) SELECT tx_id, {r(Z, 'user_amount_log_z')} FROM m")
def _(spark, d):
    return H.entity_features(transactions(spark, d), "user_key", "user").select("tx_id", "user_amount_log_z")


_OTHERS = ["merchant_key", "mcc", "channel"]


@query("win7_pair_new", f"WITH {T_} SELECT tx_id, " + ", ".join(f"(count(*) OVER {past('user_key, ' + o)} = 0)::INT AS user_{o}_new" for o in [*_OTHERS, "location"]) + " FROM (SELECT *, concat_ws('|', city_key, state_key, zip_key) AS location FROM e)")
def _(spark, d):
    tx = transactions(spark, d).withColumn("location", F.concat_ws("|", "city_key", "state_key", "zip_key"))
    return H.pair_features(tx, "user_key", [*_OTHERS, "location"], "user").select("tx_id", *(f"user_{o}_new" for o in [*_OTHERS, "location"]))


@query("win8_pair_surprisal", f"WITH {T_} SELECT tx_id, " + ", ".join(r(f"ln((count(*) OVER {past('user_key')} + 1) / (count(*) OVER {past('user_key, ' + o)} + 1)) / 10", f"user_{o}_surprisal") for o in _OTHERS) + " FROM e")
def _(spark, d):
    return H.pair_features(transactions(spark, d), "user_key", _OTHERS, "user").select("tx_id", *(f"user_{o}_surprisal" for o in _OTHERS))


@query("win9_amount_7d", f"WITH {E_}, m AS (SELECT tx_id, x, {moments('user_key', 604800)} FROM e) SELECT tx_id, {r(DELTA, 'user_amount_7d_delta')}, {r(Z, 'user_amount_7d_z')}, {r('ln(1 + n) / 5', 'user_amount_7d_support_log')} FROM m")
def _(spark, d):
    return H.recent_amount_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_amount_7d_delta", "user_amount_7d_z", "user_amount_7d_support_log")


_PHI = "((hour(ts) + minute(ts) / 60.0::DOUBLE) * (2 * 3.141592653589793::DOUBLE / 24))"
_RHYTHM = f"WITH {E_}, p AS (SELECT *, {_PHI} AS phi FROM e), m AS (SELECT tx_id, phi, count(*) OVER {past('user_key')} AS n, avg(sin(phi)) OVER {past('user_key')} AS s, avg(cos(phi)) OVER {past('user_key')} AS c, count(*) OVER {past('user_key', 86400)} AS n1, count(*) OVER {past('user_key', 604800)} AS n7 FROM p)"


@query("win10_hour_deviation", f"{_RHYTHM} SELECT tx_id, {r('CASE WHEN n > 0 THEN (1 - s * sin(phi) - c * cos(phi)) / 2 ELSE 0 END', 'user_hour_deviation')} FROM m")
def _(spark, d):
    return H.rhythm_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_hour_deviation")


@query("win11_hour_concentration", f"{_RHYTHM} SELECT tx_id, {r('CASE WHEN n > 0 THEN sqrt(s * s + c * c) ELSE 0 END', 'user_hour_concentration')} FROM m")
def _(spark, d):
    return H.rhythm_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_hour_concentration")


@query("win12_activity_share", f"{_RHYTHM} SELECT tx_id, {r('n1 / greatest(n7, 1)', 'user_activity_share')} FROM m")
def _(spark, d):
    return H.rhythm_features(tx_events(spark, d), "user_key", "user").select("tx_id", "user_activity_share")


_GROUPS = {"card_channel": ["user_key", "card_key", "channel"], "card_mcc": ["user_key", "card_key", "mcc"], "user_merchant": ["user_key", "merchant_key"], "merchant_channel": ["merchant_key", "channel"]}
for _name, _keys in _GROUPS.items():
    _k = ", ".join(_keys)

    @query(f"win13_{_name}", f"WITH {T_}, m AS (SELECT tx_id, x, count(*) OVER {past(_k)} AS c, sec - max(sec) OVER {past(_k)} AS age, {moments(_k)} FROM e) SELECT tx_id, {r('ln(1 + c) / 10', 'g_support_log')}, (c = 0)::INT AS g_cold_start, {r('coalesce(ln(1 + age) / 16, 0)', 'g_recency_log')}, {r(DELTA, 'g_amount_delta')}, {r(Z, 'g_amount_z')} FROM m")
    def _(spark, d, keys=_keys):  # noqa: ANN001, ANN202
        return H.conditional_features(transactions(spark, d), keys, "g").select("tx_id", "g_support_log", "g_cold_start", "g_recency_log", "g_amount_delta", "g_amount_z")


@query("win14_card_pairs", f"WITH {T_} SELECT tx_id, " + ", ".join(f"(count(*) OVER {past('client, ' + o)} = 0)::INT AS card_{o}_new, " + r(f"ln((count(*) OVER {past('client')} + 1) / (count(*) OVER {past('client, ' + o)} + 1)) / 10", f"card_{o}_surprisal") for o in _OTHERS) + " FROM (SELECT *, user_key || '::' || card_key AS client FROM e)")
def _(spark, d):
    tx = transactions(spark, d).withColumn("client", F.concat_ws("::", "user_key", "card_key"))
    return H.pair_features(tx, "client", _OTHERS, "card").select("tx_id", *(f"card_{o}_{x}" for o in _OTHERS for x in ("new", "surprisal")))


_MISS = f"{TX}, e AS (SELECT *, CASE WHEN channel = 'P' THEN NULL ELSE card_key END AS card FROM tx)"


@query("win15_card_missing", f"WITH {_MISS} SELECT tx_id, (card IS NULL)::INT AS card_missing, {r(f'ln(1 + count(*) OVER {past("user_key, coalesce(card, '<missing>')")}) / 10', 'per_row_log')}, {r('CASE WHEN card IS NULL THEN ln(1 + count(*) OVER ' + past('user_key') + ') / 10 ELSE ln(1 + count(*) OVER ' + past('user_key, card') + ') / 10 END', 'legacy_log')} FROM e")
def _(spark, d):
    tx = transactions(spark, d).withColumn("card", F.when(F.col("channel") != "P", F.col("card_key"))).withColumn("known", F.coalesce("card", F.lit("<missing>")))
    own, user = H.log_scaled(H.Past("user_key", "known").count(), 10), H.log_scaled(H.Past("user_key").count(), 10)
    return tx.select("tx_id", F.col("card").isNull().cast("int").alias("card_missing"), own.alias("per_row_log"), F.when(F.col("card").isNull(), user).otherwise(own).alias("legacy_log"))


@query("win16_merchant_channel_two_level", f"WITH {T_} SELECT tx_id, count(*) OVER {past('merchant_key, channel')} AS past_count, {r(f'coalesce(sum(x) OVER {past("merchant_key, channel")}, 0)', 'past_sum')} FROM e")
def _(spark, d):
    return H.two_level(transactions(spark, d), ["merchant_key", "channel"]).select("tx_id", "past_count", "past_sum")


@query("win17_chronological_id", f"WITH {TX} SELECT tx_id, user_key, merchant_key, ts FROM tx")
def _(spark, d):
    return chronological_id(tx_lineitem(spark, d), TIE).select("tx_id", "user_key", "merchant_key", "ts")


_EPISODES = f"{TX}, p AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_key, card_key ORDER BY sec, tx_id) AS gap FROM tx WHERE label = 1), ep AS (SELECT *, CASE WHEN gap IS NULL OR gap > 604800 THEN 1 ELSE 0 END AS episode_start FROM p)"


@query("win18_episode_start", f"WITH {_EPISODES} SELECT tx_id, episode_start, sum(episode_start) OVER (PARTITION BY user_key, card_key ORDER BY sec, tx_id)::BIGINT AS episode FROM ep")
def _(spark, d):
    return H.episodes(transactions(spark, d), ["user_key", "card_key"]).select("tx_id", "episode_start", "episode")


_DAILY = "(PARTITION BY user_key ORDER BY ts::DATE RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query("win19_daily_degree", f"WITH {EV} SELECT tx_id, count(*) OVER {_DAILY} AS user_degree FROM ev")
def _(spark, d):
    return H.daily_history(tx_events(spark, d), "user_key", "user").select("tx_id", "user_degree")


@query("win20_frozen_entity_mean", f"WITH {EV} SELECT tx_id, round(coalesce(avg(amount) OVER {_DAILY}, 0), 9) AS user_mean, count(*) OVER {_DAILY} AS user_degree FROM ev", 9)
def _(spark, d):
    return H.daily_history(tx_events(spark, d), "user_key", "user").select("tx_id", "user_mean", "user_degree")


@query("win21_rank_quartiles", f"WITH {EV}, k AS (SELECT tx_id, row_number() OVER (PARTITION BY channel ORDER BY amount, tx_id) AS r, count(*) OVER (PARTITION BY channel) AS n FROM ev) SELECT tx_id, ((r > 1 + (n - 1) / 4)::INT + (r > 1 + 2 * (n - 1) / 4)::INT + (r > 1 + 3 * (n - 1) / 4)::INT) AS bin FROM k")
def _(spark, d):
    return H.rank_quartiles(tx_events(spark, d), "amount", ["tx_id"], ["channel"]).select("tx_id", "bin")


@query("win22_ema", f"WITH RECURSIVE {EV}, o AS (SELECT user_key, tx_id, amount, row_number() OVER (PARTITION BY user_key ORDER BY tx_id) AS k FROM ev), m AS (SELECT user_key, tx_id, k, amount AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_key, o.tx_id, o.k, m.ema * (1 - 0.02::DOUBLE) + o.amount * 0.02::DOUBLE FROM m JOIN o ON o.user_key = m.user_key AND o.k = m.k + 1) SELECT user_key, tx_id, round(ema, 6) AS ema FROM m")
def _(spark, d):
    return H.ema(tx_events(spark, d), ["user_key"], "tx_id", "amount")


@query("win23_cumulative_gain", f"WITH {SCORED}, c AS (SELECT channel, score, count(*) AS n, sum(label) AS p FROM sc GROUP BY ALL) SELECT channel, score, (sum(p) OVER w)::BIGINT AS captured, (sum(n) OVER w)::BIGINT AS seen, round((sum(p) OVER w) / (sum(n) OVER w), 6) AS precision FROM c WINDOW w AS (PARTITION BY channel ORDER BY score DESC)")
def _(spark, d):
    from ..operators import metrics as M

    return M.running(scored(transactions(spark, d)), ["channel"]).select("channel", "score", F.col("tp").alias("captured"), F.col("seen"), (F.col("tp") / F.col("seen")).alias("precision"))


@query("win24_rank_in_group", f"WITH {TX} SELECT merchant_key, tx_id, k FROM (SELECT merchant_key, tx_id, row_number() OVER (PARTITION BY merchant_key ORDER BY tx_id DESC)::INT AS k FROM tx) WHERE k <= 10")
def _(spark, d):
    from ..operators import relational as R

    return R.top_k_per_group(transactions(spark, d), ["merchant_key"], [F.col("tx_id").desc()], 10, "k").select("merchant_key", "tx_id", "k")


@query("win25_bin_ranges", f"WITH {EV}, b AS (SELECT ntile(7) OVER (ORDER BY ts, tx_id)::INT AS bin, ts FROM ev) SELECT bin, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM b GROUP BY bin")
def _(spark, d):
    return P.equal_bins(tx_events(spark, d), 7, ["ts", "tx_id"]).groupBy("bin").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows"))


_FLAG = f"WITH {T_}, m AS (SELECT tx_id, ts, amount, x, {moments('user_key')}, count(*) OVER {past('user_key')} AS c, sec - max(sec) OVER {past('user_key')} AS age FROM e), b AS (SELECT (SELECT ts FROM tx WHERE tx_id = (SELECT floor(count(*) * 0.7)::BIGINT - 1 FROM tx)) AS t1, (SELECT ts FROM tx WHERE tx_id = (SELECT floor(count(*) * 0.85)::BIGINT - 1 FROM tx)) AS t2), f AS (SELECT CASE WHEN ts <= t1 THEN 'train' WHEN ts <= t2 THEN 'val' ELSE 'test' END AS split, ln(1 + c) / 10 AS a, (c = 0)::INT AS b, coalesce(ln(1 + age) / 16, 0) AS g, {DELTA} AS dd, {Z} AS z FROM m, b)"


@query("flagship_history_by_split", f"{_FLAG} SELECT split, count(*) AS rows, sum(b)::BIGINT AS cold, {r('avg(a)', 'prior_count_log')}, {r('avg(g)', 'since_previous_log')}, {r('avg(dd)', 'amount_log_delta')}, {r('avg(z)', 'amount_log_z')} FROM f GROUP BY split")
def _(spark, d):
    tx = H.entity_features(P.tie_safe_split(transactions(spark, d)), "user_key", "user")
    means = {"prior_count_log": "user_prior_count_log", "since_previous_log": "user_since_previous_log", "amount_log_delta": "user_amount_log_delta", "amount_log_z": "user_amount_log_z"}
    return tx.groupBy("split").agg(F.count("*").alias("rows"), F.sum("user_cold_start").alias("cold"), *(F.avg(c).alias(a) for a, c in means.items()))
