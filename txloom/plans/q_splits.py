"""Queries over temporal splits and folds (SPL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..sources.fixtures import TX, U, transactions, uniform
from .q_projections import _SPLIT
from .registry import query

DAILY = f"{TX}, daily AS (SELECT ts::DATE AS day, count(*) AS rows, sum(label)::BIGINT AS fraud FROM tx GROUP BY ALL)"


@query("spl1_rank_split", f"WITH {TX}, n AS (SELECT count(*) AS n FROM tx) SELECT tx_id, CASE WHEN tx_id < floor(n * 0.7::DOUBLE) THEN 'train' WHEN tx_id < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM tx, n")
def _(spark, d):
    return S.rank_split(transactions(spark, d)).select("tx_id", "split")


@query("spl2_tie_safe_split", f"WITH {_SPLIT} SELECT tx_id, ts, split FROM s")
def _(spark, d):
    return S.tie_safe_split(transactions(spark, d)).select("tx_id", "ts", "split")


_CAL = "CASE WHEN dd < 0 THEN NULL WHEN dd < 600 THEN 'train' WHEN dd < 700 THEN 'val' WHEN dd < 730 THEN 'gap' WHEN dd < 900 THEN 'test' END"


@query("spl3_calendar_split", f"WITH {TX} SELECT tx_id, {_CAL} AS split FROM (SELECT tx_id, ts::DATE - DATE '1996-01-01' AS dd FROM tx)")
def _(spark, d):
    return S.calendar_split(transactions(spark, d), "1996-01-01", 600, 100, 30, 170).select("tx_id", "split")


_WIN = f"{DAILY}, e AS (SELECT min(day) AS a, max(day) AS b FROM daily), w AS (SELECT i::INT AS win, a + (i * 90)::INT AS s, a + (i * 90 + 365)::INT AS e FROM e, range(1000) g(i) WHERE a + (i * 90 + 365)::INT <= b)"


@query("spl4_rolling_windows", f'WITH {_WIN} SELECT win AS "window", s::VARCHAR AS "start", w.e::VARCHAR AS "end" FROM w')
def _(spark, d):
    return S.rolling_windows(transactions(spark, d), 365, 90)


_ANCHOR = f"{DAILY}, e AS (SELECT min(day) AS a, max(day) AS b FROM daily), an AS (SELECT a + (i * 30)::INT AS anchor, b FROM e, range(1000) g(i) WHERE a + (i * 30)::INT <= b + 1), sup AS (SELECT anchor, k::INT AS fold, coalesce((SELECT sum(rows) FROM daily WHERE day >= anchor + (k * 120)::INT AND day < anchor + (k * 120 + 120)::INT), 0)::BIGINT AS rows, coalesce((SELECT sum(fraud) FROM daily WHERE day >= anchor + (k * 120)::INT AND day < anchor + (k * 120 + 120)::INT), 0)::BIGINT AS fraud FROM an, range(3) h(k) WHERE anchor + (k * 120 + 120)::INT <= b + 1), ok AS (SELECT anchor FROM sup GROUP BY anchor HAVING count(*) = 3 AND min(fraud) >= 5 AND min(rows - fraud) >= 50)"


def _support(spark, d):  # noqa: ANN001, ANN202
    return S.anchor_support(S.daily_counts(transactions(spark, d)), 3, 120, 30)


@query("spl5_first_eligible_anchor", f"WITH {_ANCHOR} SELECT sup.* REPLACE (anchor::VARCHAR AS anchor) FROM sup WHERE anchor = (SELECT min(anchor) FROM ok)")
def _(spark, d):
    support = _support(spark, d)
    first = S.eligible_anchors(support, 3, 5, 50).agg(F.min("anchor").alias("anchor"))
    return support.join(F.broadcast(first), "anchor")


FOLDS = [("f1", {"train": ("1996-01-01", "1997-01-01"), "selection": ("1997-01-15", "1997-04-01"), "assessment": ("1997-04-15", "1997-07-01")}), ("f2", {"train": ("1997-01-01", "1998-01-01"), "selection": ("1998-01-15", "1998-04-01"), "assessment": ("2035-01-01", "2036-01-01")})]
_FOLDS = "f(fold, role, a, b) AS (VALUES " + ", ".join(f"('{f}', '{r}', DATE '{a}', DATE '{b}')" for f, roles in FOLDS for r, (a, b) in roles.items()) + ")"


@query("spl6_calendar_folds", f'WITH {TX}, {_FOLDS} SELECT fold, role, a::VARCHAR AS "start", b::VARCHAR AS "end", count(tx_id) AS rows, coalesce(sum(label), 0)::BIGINT AS fraud FROM f LEFT JOIN tx ON ts >= a AND ts < b GROUP BY ALL')
def _(spark, d):
    return S.fold_support(transactions(spark, d), S.calendar_folds(FOLDS, spark))


@query("spl7_nearest_anchors", f'WITH {_ANCHOR}, m AS (SELECT list_sort(list(anchor))[((count(*) - 1) // 2 + 1)::INT] AS middle FROM ok), t AS (SELECT o::INT AS "offset", middle + o::INT AS target FROM m, (VALUES (-400), (-100), (0), (45), (400)) v(o)) SELECT "offset", target::VARCHAR AS target, arg_min(anchor, abs(anchor - target) * 100000 + (anchor - DATE \'1900-01-01\'))::VARCHAR AS anchor FROM ok, t GROUP BY ALL')
def _(spark, d):
    return S.nearest_anchors(S.eligible_anchors(_support(spark, d), 3, 5, 50), [-400, -100, 0, 45, 400])


@query("spl8_parity_blocks", f"WITH {TX}, n AS (SELECT floor(count(*) * 0.75)::BIGINT AS n FROM tx), t AS (SELECT min(sec) AS t FROM tx, n WHERE tx_id >= n) SELECT tx_id, CASE WHEN (sec // 604800) % 2 = 0 THEN 'selection' ELSE 'calibration' END AS role FROM tx, t WHERE sec >= t")
def _(spark, d):
    return S.parity_blocks(transactions(spark, d)).select("tx_id", "role")


@query("spl9_selection_tail", f"WITH {TX}, n AS (SELECT floor(count(*) * (1 - 0.02::DOUBLE))::BIGINT AS n FROM tx), p AS (SELECT min(tx_id) AS p FROM (SELECT tx_id FROM tx WHERE label = 1 ORDER BY tx_id DESC LIMIT 40)) SELECT tx_id, label FROM tx, n, p WHERE tx_id >= least(n, p)")
def _(spark, d):
    return S.selection_tail(transactions(spark, d), 0.02, 40).select("tx_id", "label")


@query("spl10_source_order", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= round_even(count(*) OVER () * 0.8::DOUBLE, 0) THEN 'train' ELSE 'val' END AS role FROM events")
def _(spark, d):
    from ..sources.fixtures import table

    return S.source_order_split(table(spark, d, "events"), "event_id").select("event_id", "role")


@query("spl11_split_statistics", f"WITH {_SPLIT} SELECT split, count(*) AS rows, sum(label)::BIGINT AS fraud, count(DISTINCT user_key) AS users, count(DISTINCT merchant_key) AS merchants, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, round(sum(label) * 100.0::DOUBLE / count(*), 6) AS fraud_rate, count(*) + count(DISTINCT user_key) + count(DISTINCT merchant_key) AS nodes FROM s GROUP BY split")
def _(spark, d):
    return S.split_statistics(S.tie_safe_split(transactions(spark, d)))


@query("spl12_equal_bins", f"WITH {TX} SELECT tx_id, ntile(7) OVER (PARTITION BY channel ORDER BY ts, tx_id)::INT AS bin FROM tx")
def _(spark, d):
    return S.equal_bins(transactions(spark, d), 7, ["ts", "tx_id"], ["channel"]).select("tx_id", "bin")


@query("spl13_drift", f"WITH {_SPLIT}, tr AS (SELECT * FROM s WHERE split = 'train'), te AS (SELECT * FROM s WHERE split = 'test') SELECT count(*) AS rows, " + ", ".join(f"round(avg(({k} NOT IN (SELECT {k} FROM tr WHERE {k} IS NOT NULL) AND {k} IS NOT NULL)::INT), 6) AS {k}_unseen" for k in ("user_key", "merchant_key", "mcc")) + ", round(avg((amount < (SELECT min(amount) FROM tr) OR amount > (SELECT max(amount) FROM tr))::INT), 6) AS amount_outside, max((ts = (SELECT max(ts) FROM tr))::INT) AS boundary_tie FROM te")
def _(spark, d):
    s = S.tie_safe_split(transactions(spark, d))
    return S.drift(s.filter("split = 'train'"), s.filter("split = 'test'"), ["user_key", "merchant_key", "mcc"])


@query("spl14_embargo_ablation", f"WITH {TX}, g AS (SELECT (ts::DATE - DATE '1996-01-01') AS dd, label, gap::INT AS gap FROM tx, (VALUES (0), (8), (30)) v(gap)), s AS (SELECT *, CASE WHEN dd < 0 THEN NULL WHEN dd < 600 THEN 'train' WHEN dd < 700 THEN 'val' WHEN dd < 700 + gap THEN NULL WHEN dd < 870 + gap THEN 'test' END AS split FROM g) SELECT gap, split, count(*) AS rows, sum(label)::BIGINT AS fraud FROM s WHERE split IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return S.embargo_ablation(transactions(spark, d), [0, 8, 30], "1996-01-01", 600, 100, 170)


@query("spl15_window_sweep", f"WITH {_WIN}, m AS (SELECT win, avg(label) AS rate, avg(amount) AS amount FROM tx JOIN w ON ts >= s AND ts < w.e GROUP BY win) SELECT count(*) AS windows, round(avg(rate), 6) AS rate_mean, round(stddev_samp(rate), 6) AS rate_sd, round(avg(amount), 4) AS amount_mean, round(stddev_samp(amount), 4) AS amount_sd FROM m")
def _(spark, d):
    t = transactions(spark, d)
    out = S.window_sweep(t, S.rolling_windows(t, 365, 90))
    return out.withColumns({c: F.round(c, 4) for c in ("amount_mean", "amount_sd")})


@query("spl16_smoke_subset", f"WITH {TX}, p AS (SELECT tx_id, label FROM (SELECT tx_id, label, row_number() OVER (ORDER BY tx_id) AS k, count(*) OVER () AS n FROM tx WHERE label = 1) WHERE k <= floor(n * 0.25)), q AS (SELECT tx_id, label FROM tx WHERE label = 0 ORDER BY {U.format("'7|' || tx_id")}, tx_id LIMIT 300) SELECT * FROM p UNION ALL SELECT * FROM q")
def _(spark, d):
    return S.smoke_subset(transactions(spark, d), 0.25, 300, uniform(7, "tx_id")).select("tx_id", "label")
