"""Queries over the graph and its aggregates (GRA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import splits as S
from ..sources.fixtures import EV, TX, U, transactions, tx_events, uniform
from .q_projections import _SPLIT
from .registry import query

DEG = f"{TX}, u AS (SELECT user_key, count(*) AS d_u, sum(label)::BIGINT AS f_u FROM tx GROUP BY ALL), m AS (SELECT merchant_key, count(*) AS d_m, sum(label)::BIGINT AS f_m FROM tx GROUP BY ALL), p AS (SELECT user_key, merchant_key, count(*) AS c, sum(label)::BIGINT AS cf FROM tx GROUP BY ALL), g AS (SELECT tx.*, d_u, f_u, d_m, f_m, c, cf FROM tx JOIN u USING (user_key) JOIN m USING (merchant_key) JOIN p USING (user_key, merchant_key))"


def degrees(spark, d):  # noqa: ANN001, ANN201
    return G.with_degrees(transactions(spark, d))


def per_row(name, expression, sql):  # noqa: ANN001, ANN201
    """A query of one column expression over transactions with degrees."""

    @query(name, f"WITH {DEG} SELECT tx_id, {sql} AS x FROM g")
    def _(spark, d):
        return degrees(spark, d).select("tx_id", expression().alias("x"))


@query("gra1_entity_codes", f"WITH {TX} SELECT merchant_key, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT merchant_key, min(tx_id) AS f FROM tx GROUP BY ALL)")
def _(spark, d):
    return G.entity_codes(transactions(spark, d), "merchant_key").withColumn("code", F.col("code").cast("long"))


@query("gra2_directed_edges", f"WITH {TX} SELECT 'buys' AS relation, 'u' || user_key AS src, 't' || tx_id AS dst FROM tx UNION ALL SELECT 'rev_buys', 't' || tx_id, 'u' || user_key FROM tx UNION ALL SELECT 'sells', 'm' || merchant_key, 't' || tx_id FROM tx UNION ALL SELECT 'rev_sells', 't' || tx_id, 'm' || merchant_key FROM tx")
def _(spark, d):
    return G.edges(transactions(spark, d))


_ADJ = "SELECT side, entity, row_number() OVER (PARTITION BY side, entity ORDER BY tx_id) - 1 AS place, tx_id, other FROM (SELECT 'user' AS side, user_key AS entity, tx_id, merchant_key AS other FROM {0} UNION ALL SELECT 'merchant', merchant_key, tx_id, user_key FROM {0})"


@query("gra3_train_adjacency", f"WITH {_SPLIT}, tr AS (SELECT * FROM s WHERE split = 'train') {_ADJ.format('tr')}")
def _(spark, d):
    s = S.tie_safe_split(transactions(spark, d)).filter("split = 'train'")
    return G.adjacency(s).select("side", "entity", F.col("place").cast("long").alias("place"), "tx_id", "other")


@query("gra4_cutoff_adjacency", f"WITH {TX}, a AS ({_ADJ.format('tx')}) SELECT * FROM a WHERE tx_id < 2000")
def _(spark, d):
    return G.adjacency(transactions(spark, d), before=2000).select("side", "entity", F.col("place").cast("long").alias("place"), "tx_id", "other")


@query("gra5_degrees", f"WITH {TX} SELECT user_key, count(*) AS u_degree, sum(label)::BIGINT AS u_fraud FROM tx GROUP BY ALL")
def _(spark, d):
    return G.degrees(transactions(spark, d), "user_key", "u")


@query("gra6_pair_count", f"WITH {TX} SELECT tx_id, count(*) OVER (PARTITION BY user_key, merchant_key) AS c FROM tx")
def _(spark, d):
    return degrees(spark, d).select("tx_id", "c")


@query("gra7_node_features", f"WITH {_SPLIT}, nd AS (SELECT user_key, avg(amount) AS a, count(*)::DOUBLE AS n FROM tx GROUP BY ALL), f AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(n) AS nm, stddev_pop(n) AS nsd FROM (SELECT avg(amount) AS a, count(*)::DOUBLE AS n FROM s WHERE split = 'train' GROUP BY user_key)) SELECT user_key, round((a - am) / asd, 6) AS mean_amount, round((n - nm) / nsd, 6) AS count FROM nd, f")
def _(spark, d):
    t = S.tie_safe_split(transactions(spark, d))
    return G.node_features(t, t.filter("split = 'train'"), "user_key")


@query("gra8_node_padding", f"WITH {TX} SELECT 't' || tx_id AS node, round(amount, 6) AS amount, round(ln(3), 6) AS log_degree, 1 AS is_tx, 0 AS is_user, 0 AS is_merchant FROM tx UNION ALL SELECT 'u' || user_key, 0, round(ln(1 + count(*)), 6), 0, 1, 0 FROM tx GROUP BY user_key UNION ALL SELECT 'm' || merchant_key, 0, round(ln(1 + count(*)), 6), 0, 0, 1 FROM tx GROUP BY merchant_key")
def _(spark, d):
    return G.padded_nodes(transactions(spark, d))


for _name, _op, _arg, _k in (("ratio", G.undersample_ratio, 0.5, "floor(p / 0.5)"), ("capped", G.undersample_capped, 0.01, "floor(p / 0.01)"), ("share", G.undersample_share, 0.25, "floor((n - p) * 0.25)")):

    @query(f"gra9_undersample_{_name}", f"WITH {TX}, k AS (SELECT count(*) AS n, sum(label) AS p FROM tx), r AS (SELECT tx_id, label, row_number() OVER (ORDER BY {U.format("'9|' || tx_id")}, tx_id) AS r FROM tx WHERE label = 0) SELECT tx_id, label FROM tx WHERE label = 1 UNION ALL SELECT tx_id, label FROM r, k WHERE r <= {_k}")
    def _(spark, d, op=_op, arg=_arg):  # noqa: ANN001, ANN202
        return op(transactions(spark, d), arg, uniform(9, "tx_id")).select("tx_id", "label")


@query("gra10_graph_statistics", f"WITH {TX} SELECT count(*) AS transactions, count(DISTINCT user_key) AS users, count(DISTINCT merchant_key) AS merchants, count(*) + count(DISTINCT user_key) + count(DISTINCT merchant_key) AS nodes, count(*) * 2 AS undirected_edges, count(*) * 4 AS directed_edges FROM tx")
def _(spark, d):
    return G.statistics(transactions(spark, d))


@query("gra11_coordinates", f"WITH {TX}, k AS (SELECT tx_id + 1 AS t, count(*) OVER () + dense_rank() OVER (ORDER BY user_key) AS u, count(*) OVER () + (SELECT count(DISTINCT user_key) FROM tx) + dense_rank() OVER (ORDER BY merchant_key) AS m FROM tx) SELECT t AS \"row\", u AS col FROM k UNION ALL SELECT u, t FROM k UNION ALL SELECT t, m FROM k UNION ALL SELECT m, t FROM k")
def _(spark, d):
    return G.coordinates(transactions(spark, d))


@query("gra12_majority_label", f"WITH {TX} SELECT user_key, CASE WHEN avg(k) IS NULL THEN -1 WHEN avg(k) >= 0.5 THEN 1 ELSE 0 END AS majority FROM (SELECT user_key, CASE WHEN tx_id % 3 = 0 THEN label END AS k FROM tx) GROUP BY ALL")
def _(spark, d):
    known = transactions(spark, d).withColumn("label", F.when(F.col("tx_id") % 3 == 0, F.col("label")))
    return G.majority_label(known, "user_key")


per_row("gra13_jaccard", G.pair_jaccard, "round(least(greatest(c / greatest(d_u + d_m - c, 1), 0), 1), 6)")

_F = f"{TX}, f AS (SELECT *, amount / 10000 AS a, zip_key::DOUBLE / 10 AS z, label::DOUBLE AS l FROM tx)"


@query("gra14_attribute_homophily", f"WITH {_F}, m AS (SELECT merchant_key, avg(a) AS ma, avg(z) AS mz FROM f GROUP BY ALL) SELECT tx_id, round((1 + CASE WHEN sqrt(a * a + z * z) * sqrt(ma * ma + mz * mz) > 1e-12 THEN (a * ma + z * mz) / (sqrt(a * a + z * z) * sqrt(ma * ma + mz * mz)) ELSE 0 END) / 2, 6) AS homophily FROM f JOIN m USING (merchant_key)")
def _(spark, d):
    t = transactions(spark, d).withColumns({"a": F.col("amount") / 10000, "z": F.col("zip_key").cast("double") / 10})
    return G.attribute_homophily(t, ["a", "z"], "merchant_key").select("tx_id", "homophily")


def _rank_sql(steps: int = 3) -> str:
    parts = [f"WITH {TX}, pr AS (SELECT user_key, merchant_key, count(*) AS w FROM tx GROUP BY ALL), arcs AS (SELECT 'u' AS sa, user_key AS a, 'm' AS sb, merchant_key AS b, w FROM pr UNION ALL SELECT 'm', merchant_key, 'u', user_key, w FROM pr), nodes AS (SELECT sa AS s, a AS e, sum(w)::DOUBLE AS d FROM arcs GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT s, e, 1 / n AS r FROM nodes, n)"]
    for k in range(steps):
        parts.append(f"r{k + 1} AS (SELECT nodes.s, nodes.e, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(i.x, 0) AS r FROM nodes CROSS JOIN n LEFT JOIN (SELECT sb AS s, b AS e, sum(w / q.d * r.r) AS x FROM arcs JOIN nodes q ON q.s = sa AND q.e = a JOIN r{k} r ON r.s = sa AND r.e = a GROUP BY ALL) i ON i.s = nodes.s AND i.e = nodes.e)")
    return ", ".join(parts) + f" SELECT s AS side, e AS entity, round((r - min(r) OVER (PARTITION BY s)) / (max(r) OVER (PARTITION BY s) - min(r) OVER (PARTITION BY s)), 6) AS rank FROM r{steps}"


@query("gra15_pagerank", _rank_sql())
def _(spark, d):
    return G.pagerank(transactions(spark, d))


per_row("gra16_ppr_closed_form", lambda: G.ppr_weight("d_u", "d_m") * 1000, "round((0.15::DOUBLE * 0.85::DOUBLE / d_u + 0.85::DOUBLE ** 3 / (2 * d_u) * (1 + c / d_m)) * 1000, 6)")


@query("gra17_ppr_by_steps", f"WITH {DEG} SELECT user_key, tx_id, round((0.15::DOUBLE * 0.85::DOUBLE / d_u + 0.85::DOUBLE ** 3 / (2 * d_u) * (1 + c / d_m)) * 1000, 9) AS ppr FROM g", 9)
def _(spark, d):
    stepped = G.ppr_by_steps(transactions(spark, d))
    return stepped.withColumn("ppr", F.col("ppr") * 1000)


per_row("gra18_historical_homophily", lambda: G.historical_homophily("d_u", "f_u"), "round((CASE WHEN label = 1 THEN f_u - label ELSE d_u - 1 - (f_u - label) END + 20 * 0.5) / (d_u - 1 + 20), 6)")
per_row("gra19_projected_degree", G.projected_degree, "d_u + d_m - c - 1")
per_row("gra20_reciprocal_degree", G.reciprocal_degree, "round(1 / sqrt(d_u::DOUBLE * d_m), 6)")
per_row("gra20_label_homophily", G.label_homophily, "round(CASE WHEN label = 1 THEN f_u ELSE d_u - f_u END / d_u, 6)")
per_row("gra21_counterpart_score", lambda: G.counterpart_score("d_m"), "round(1 / ln(1 + greatest(d_m, 1)), 6)")

for _mode, _sql in (("add", "x ** 2 + 0.1"), ("convex", "0.1 + 0.9 * x ** 2")):

    @query(f"gra22_floor_{_mode}", f"WITH {DEG}, y AS (SELECT tx_id, (d_m - min(d_m) OVER (PARTITION BY channel)) / greatest(max(d_m) OVER (PARTITION BY channel) - min(d_m) OVER (PARTITION BY channel), 1) AS x FROM g) SELECT tx_id, round({_sql}, 6) AS weight FROM y")
    def _(spark, d, mode=_mode):  # noqa: ANN001, ANN202
        return G.floored(degrees(spark, d), "d_m", ["channel"], 0.1, 2.0, mode).select("tx_id", "weight")


_EDAY = "(SELECT max(ts)::DATE FROM ev)"


def _last_day(df):  # noqa: ANN001, ANN202
    return str(df.agg(F.to_date(F.max("ts"))).first()[0])


@query("gra23_causal_context", f"WITH {EV}, t AS (SELECT * FROM ev WHERE ts::DATE = {_EDAY}), h AS (SELECT * FROM ev WHERE ts::DATE < {_EDAY}) SELECT tx_id FROM h WHERE user_key IN (SELECT user_key FROM t) OR merchant_key IN (SELECT merchant_key FROM t)")
def _(spark, d):
    e = tx_events(spark, d)
    return G.causal_context(e, _last_day(e))


@query("gra24_causal_edges", f"WITH {EV} SELECT relation, count(*) AS edges, count(DISTINCT dst) AS targets FROM (SELECT 'buys' AS relation, 't' || tx_id AS dst FROM ev UNION ALL SELECT 'sells', 't' || tx_id FROM ev UNION ALL SELECT 'rev_buys', 'u' || user_key FROM ev WHERE ts::DATE < {_EDAY} UNION ALL SELECT 'rev_sells', 'm' || merchant_key FROM ev WHERE ts::DATE < {_EDAY}) GROUP BY ALL")
def _(spark, d):
    e = tx_events(spark, d)
    return G.causal_edges(e, _last_day(e)).groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets"))


@query("gra25_camouflage_mask", f"WITH {_SPLIT}, tr AS (SELECT * FROM s WHERE split = 'train'), u AS (SELECT user_key, count(*) AS d_u, sum(label) AS f_u FROM tr GROUP BY ALL), m AS (SELECT merchant_key, count(*) AS d_m, sum(label) AS f_m FROM tr GROUP BY ALL), p AS (SELECT user_key, merchant_key, count(*) AS c, sum(label) AS cf FROM tr GROUP BY ALL), j AS (SELECT tx_id, label, (coalesce(d_u, 0) + coalesce(d_m, 0) - coalesce(c, 0))::BIGINT AS n, coalesce(f_u, 0) + coalesce(f_m, 0) - coalesce(cf, 0) AS f FROM s LEFT JOIN u USING (user_key) LEFT JOIN m USING (merchant_key) LEFT JOIN p USING (user_key, merchant_key) WHERE split = 'test') SELECT tx_id, n AS seen, CASE WHEN n > 0 THEN round((n - f) / n, 6) END AS normal_share, (label = 1 AND n > 0 AND coalesce((n - f) / n > 0.9, FALSE))::INT AS masked FROM j")
def _(spark, d):
    s = S.tie_safe_split(transactions(spark, d))
    return G.camouflage(s.filter("split = 'train'"), s.filter("split = 'test'"))


@query("gra26_neighbour_means", f"WITH {TX}, k AS (SELECT merchant_key AS entity, tx_id, amount, label, row_number() OVER (PARTITION BY merchant_key ORDER BY tx_id DESC) AS r FROM tx) SELECT entity, round(avg(amount) + 1e-7, 4) AS amount, round(avg(label) + 1e-7, 4) AS label FROM k WHERE r <= 25 GROUP BY entity")
def _(spark, d):
    from ..operators import relational as R

    t = transactions(spark, d)
    near = R.top_k_per_group(t.select(F.col("merchant_key").alias("entity"), "tx_id"), ["entity"], [F.col("tx_id").desc()], 25, "r").select("entity", "tx_id")
    return G.neighbour_means(near, t.select("tx_id", "amount", F.col("label").cast("double").alias("label")), ["amount", "label"]).withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("amount", "label")})


@query("gra27_spectral_sketch")
def _(spark, d):
    return G.spectral_sketch(transactions(spark, d))
