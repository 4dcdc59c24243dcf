"""Queries over samples (SAM); draws are hashes, so SQL checks the very rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import sampling as A
from ..sources.fixtures import EV, TX, U, transactions, tx_events, uniform
from .registry import query

EDGE = f"{TX}, e AS (SELECT merchant_key AS entity, tx_id, ts, label, 1 + abs(amount) AS w FROM tx)"
CL = "greatest(least({0}, 1 - 2.0::DOUBLE ** -53), 2.0::DOUBLE ** -53)".format


def edges(spark, d):  # noqa: ANN001, ANN201
    return transactions(spark, d).select(F.col("merchant_key").alias("entity"), "tx_id", "ts", "label", (1 + F.abs("amount")).alias("w"))


def g(*parts: str, weight: str | None = None) -> str:
    u = CL(U.format(" || '|' || ".join(parts)))
    return (f"ln({weight}) - " if weight else "-") + f"ln(-ln({u}))"


@query("sam1_uniform", f"WITH {EDGE} SELECT entity, tx_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'1'", 'entity', 'tx_id')} DESC, tx_id) AS r FROM e) WHERE r <= 10")
def _(spark, d):
    return A.neighbours(edges(spark, d), 10, 1).select("entity", "tx_id", "rank")


@query("sam2_weighted_gumbel", f"WITH {EDGE} SELECT entity, tx_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'2'", 'entity', 'tx_id', weight='w')} DESC, tx_id) AS r FROM e) WHERE r <= 10")
def _(spark, d):
    return A.neighbours(edges(spark, d), 10, 2, weight="w").select("entity", "tx_id", "rank")


@query("sam3_sequential_weighted", f"WITH {EDGE}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'3'", 'entity', 'tx_id', weight='w')} DESC, tx_id) AS r FROM e) SELECT entity, tx_id, label FROM k WHERE r <= 5")
def _(spark, d):
    # drawing one after another by weight has the Gumbel top-k's distribution
    return A.neighbours(edges(spark, d), 5, 3, weight="w").select("entity", "tx_id", "label")


@query("sam4_small_degrees", f"WITH {TX}, e AS (SELECT user_key AS entity, tx_id FROM tx), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'4'", 'entity', 'tx_id')} DESC, tx_id) AS r FROM e) SELECT entity, count(*) AS degree, count(*) FILTER (r <= 30) AS taken FROM k GROUP BY entity")
def _(spark, d):
    e = transactions(spark, d).select(F.col("user_key").alias("entity"), "tx_id")
    taken = A.neighbours(e, 30, 4).groupBy("entity").agg(F.count("*").alias("taken"))
    return e.groupBy("entity").agg(F.count("*").alias("degree")).join(taken, "entity")


@query("sam5_hub_top_k", f"WITH {EDGE}, h AS (SELECT entity FROM e GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 3), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'5'", 'entity', 'tx_id', weight='w')} DESC, tx_id) AS r FROM e WHERE entity IN (SELECT entity FROM h)) SELECT entity, tx_id FROM k WHERE r <= 25")
def _(spark, d):
    e = edges(spark, d)
    hubs = e.groupBy("entity").count().orderBy(F.col("count").desc(), "entity").limit(3)
    return A.neighbours(e.join(hubs, "entity", "left_semi"), 25, 5, weight="w").select("entity", "tx_id")


_ROOTS = f"{EDGE}, roots AS (SELECT tx_id AS root, merchant_key AS entity, ts::DATE AS day FROM tx WHERE label = 1)"


def _roots(spark, d):  # noqa: ANN001, ANN202
    return transactions(spark, d).filter("label = 1").select(F.col("tx_id").alias("root"), F.col("merchant_key").alias("entity"), F.to_date("ts").alias("day"))


for _mode, _when in (("static", "TRUE"), ("frozen", "e.ts < TIMESTAMP '1997-01-01'"), ("moving", "e.ts::DATE < day")):

    @query(f"sam7_{_mode}", f"WITH {_ROOTS}, k AS (SELECT root, e.tx_id, row_number() OVER (PARTITION BY root ORDER BY {g("'6'", 'root', 'e.tx_id')} DESC, e.tx_id) AS r FROM roots JOIN e USING (entity) WHERE e.tx_id <> root AND {_when}) SELECT root, tx_id, r::INT AS rank FROM k WHERE r <= 8")
    def _(spark, d, mode=_mode):  # noqa: ANN001, ANN202
        return A.causal_neighbours(_roots(spark, d), edges(spark, d).select("entity", "tx_id", "ts"), 8, 6, mode, "1997-01-01")


@query("sam8_recent", f"WITH {_ROOTS}, k AS (SELECT root, e.tx_id, e.ts::DATE >= day - 180 AS new, {g("'6'", 'root', 'e.tx_id')} AS u FROM roots JOIN e USING (entity) WHERE e.tx_id <> root AND e.ts::DATE < day), q AS (SELECT *, row_number() OVER (PARTITION BY root, new ORDER BY u DESC, tx_id) AS r FROM k), t AS (SELECT root, tx_id, row_number() OVER (PARTITION BY root ORDER BY CASE WHEN new AND r <= 3 THEN 0 WHEN NOT new THEN 1 ELSE 2 END, r, tx_id) AS rank FROM q) SELECT root, tx_id, rank::INT AS rank FROM t WHERE rank <= 8")
def _(spark, d):
    return A.causal_neighbours(_roots(spark, d), edges(spark, d).select("entity", "tx_id", "ts"), 8, 6, "recent", recent=3)


_ADJ = f"{TX}, a AS (SELECT 'user:' || user_key AS k, tx_id FROM tx UNION ALL SELECT 'merchant:' || merchant_key, tx_id FROM tx), roots AS (SELECT tx_id AS root FROM tx WHERE label = 1)"


def _table(seed: int, k: int, name: str) -> str:
    return f"{name} AS (SELECT k, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {g(f"'{seed}'", 'k', 'tx_id')} DESC, tx_id) AS r FROM a) WHERE r <= {k})"


def _adjacency(spark, d):  # noqa: ANN001, ANN202
    from ..operators.graph import adjacency

    return adjacency(transactions(spark, d)).select("side", "entity", "tx_id")


def _tx_roots(spark, d):  # noqa: ANN001, ANN202
    return transactions(spark, d).filter("label = 1").select(F.col("tx_id").alias("root"))


@query("sam9_two_layers", f"WITH {_ADJ}, {_table(11, 25, 't1')}, {_table(12, 10, 't2')}, l1 AS (SELECT DISTINCT root, root AS dst, t1.tx_id AS src FROM roots JOIN a ON a.tx_id = root JOIN t1 ON t1.k = a.k WHERE t1.tx_id <> root), l2 AS (SELECT DISTINCT root, src AS dst, t2.tx_id AS src FROM l1 JOIN a ON a.tx_id = src JOIN t2 ON t2.k = a.k WHERE t2.tx_id <> src) SELECT root, 1 AS layer, dst, src FROM l1 UNION ALL SELECT root, 2, dst, src FROM l2")
def _(spark, d):
    from ..operators.graph import adjacency

    t = transactions(spark, d)
    return A.two_layers(adjacency(t.filter("label = 1")), adjacency(t), (25, 10), 11)


@query("sam10_frontier", f"WITH {_ADJ}, {_table(22, 4, 't1')}, {_table(23, 4, 't2')}, h1 AS (SELECT DISTINCT t1.tx_id FROM roots JOIN a ON a.tx_id = root JOIN t1 ON t1.k = a.k WHERE t1.tx_id NOT IN (SELECT root FROM roots)), h2 AS (SELECT DISTINCT t2.tx_id FROM h1 JOIN a ON a.tx_id = h1.tx_id JOIN t2 ON t2.k = a.k WHERE t2.tx_id NOT IN (SELECT root FROM roots) AND t2.tx_id NOT IN (SELECT tx_id FROM h1)) SELECT root AS tx_id, 0 AS hop FROM roots UNION ALL SELECT tx_id, 1 FROM h1 UNION ALL SELECT tx_id, 2 FROM h2")
def _(spark, d):
    return A.frontier(_tx_roots(spark, d), _adjacency(spark, d), 2, 4, 21)


@query("sam11_weight_contract", f"WITH {EDGE} SELECT count(*) FILTER (NOT isfinite(w)) AS not_finite, count(*) FILTER (w <= 0) AS not_positive, count(*) FILTER (w < 2000) AS below_floor, (SELECT count(*) FROM (SELECT entity FROM e GROUP BY entity HAVING NOT sum(w) > 0)) AS empty_groups FROM e")
def _(spark, d):
    return A.contract(edges(spark, d), "entity", "w", 2000.0)


@query("sam12_weight_audit", f"WITH {EDGE} SELECT entity, round(min(w), 4) AS min, round(max(w), 4) AS max, round(avg(w), 4) AS mean, round(stddev_pop(w), 4) AS std, count(DISTINCT w) AS \"unique\" FROM e GROUP BY entity")
def _(spark, d):
    return A.weight_audit(edges(spark, d), "entity", "w").withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "std")})


@query("sam13_balanced_roots", f"WITH {TX} SELECT tx_id, label FROM tx WHERE label = 1 UNION ALL SELECT tx_id, label FROM (SELECT tx_id, label, row_number() OVER (ORDER BY {U.format("'13|5|' || tx_id")}, tx_id) AS r FROM tx WHERE label = 0) WHERE r <= (SELECT 2 * sum(label) FROM tx)")
def _(spark, d):
    return A.balanced_roots(transactions(spark, d), 2, 5, 13).select("tx_id", "label")


@query("sam14_stratified_roots", f"WITH {TX}, q AS (SELECT channel, floor(count(*) * 500 / (SELECT sum(label) FROM tx)) AS q FROM tx WHERE label = 1 GROUP BY channel), k AS (SELECT tx_id, label, {U.format("'14|' || tx_id")} AS u, row_number() OVER (PARTITION BY channel ORDER BY {U.format("'14|' || tx_id")}, tx_id) AS r, coalesce(q, 0) AS q FROM tx LEFT JOIN q USING (channel) WHERE label = 0) SELECT tx_id, label FROM tx WHERE label = 1 UNION ALL SELECT tx_id, label FROM (SELECT *, row_number() OVER (ORDER BY (r > q)::INT, u, tx_id) AS z FROM k) WHERE z <= 500")
def _(spark, d):
    return A.stratified_roots(transactions(spark, d), ["channel"], 500, 14).select("tx_id", "label")


@query("sam15_cohort", f"WITH {TX}, k AS (SELECT tx_id, label, {U.format("'15|' || tx_id")} AS u FROM tx) SELECT DISTINCT tx_id, label FROM ((SELECT * FROM k ORDER BY u, tx_id LIMIT 400) UNION ALL (SELECT * FROM k WHERE label = 1 ORDER BY u, tx_id LIMIT 150))")
def _(spark, d):
    return A.cohort(transactions(spark, d).select("tx_id", "label"), 400, 150, 15)


@query("sam16_paired_draws", f"WITH {TX} SELECT tx_id, rep::INT AS rep, channel, {U.format("'16|' || rep || '|' || tx_id || '|' || channel")} AS u FROM tx, range(1, 4) r(rep)")
def _(spark, d):
    t = transactions(spark, d).select("tx_id", "channel", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rep"))
    return t.select("tx_id", "rep", "channel", uniform(16, "rep", "tx_id", "channel").alias("u"))


@query("sam17_batches", "SELECT event_id, CASE WHEN n % 1111 = 1 AND n > 1 AND r = n - 1 THEN r // 1111 - 1 ELSE r // 1111 END::BIGINT AS batch FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events)")
def _(spark, d):
    from ..sources.fixtures import table

    return A.batches(table(spark, d, "events"), 1111, "event_id").select("event_id", F.col("batch").cast("long").alias("batch"))


@query("sam18_majority_down", f"WITH {TX} SELECT tx_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {U.format("'18|' || tx_id")}, tx_id) AS r FROM tx) WHERE r <= 200")
def _(spark, d):
    return A.majority_down(transactions(spark, d).select("tx_id", "label"), 200, 18)


@query("sam19_inclusion", f"WITH {EV}, e AS (SELECT merchant_key AS entity, tx_id, 1 + abs(amount) AS w FROM ev), k AS (SELECT entity, tx_id, n, row_number() OVER (PARTITION BY n, entity ORDER BY {g("'19'", 'n', 'entity', 'tx_id', weight='w')} DESC, tx_id) AS r FROM e, range(1, 21) d(n)), t AS (SELECT entity, tx_id, count(*) / 20.0::DOUBLE AS x FROM k WHERE r <= 5 GROUP BY ALL) SELECT entity, tx_id, coalesce(x, 0) AS inclusion FROM e LEFT JOIN t USING (entity, tx_id)")
def _(spark, d):
    e = tx_events(spark, d).select(F.col("merchant_key").alias("entity"), "tx_id", (1 + F.abs("amount")).alias("w"))
    return A.inclusion(e, 20, 5, 19, weight="w")


@query("sam20_picked_groups", f"WITH {TX}, s AS (SELECT user_key, count(*) AS n FROM tx GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY n, user_key) - 1 AS r, count(*) OVER () AS m FROM s) SELECT user_key, n FROM k WHERE r IN (SELECT round_even(i * ((SELECT count(*) FROM s) - 1) / 6.0::DOUBLE, 0)::BIGINT FROM range(7) x(i))")
def _(spark, d):
    sizes = transactions(spark, d).groupBy("user_key").agg(F.count("*").alias("n"))
    return A.picked_groups(sizes, ["n", "user_key"], 7)


@query("met21_sampler_jaccard", f"WITH {EDGE}, a AS (SELECT entity, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'1'", 'entity', 'tx_id')} DESC, tx_id) AS r FROM e) WHERE r <= 20), b AS (SELECT entity, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {g("'2'", 'entity', 'tx_id', weight='w')} DESC, tx_id) AS r FROM e) WHERE r <= 20), x AS (SELECT entity, count(a.tx_id) AS na, count(b.tx_id) AS nb, count(*) FILTER (a.tx_id = b.tx_id) AS nab FROM a FULL JOIN b USING (entity, tx_id) GROUP BY entity) SELECT entity, round(nab / (na + nb - nab), 6) AS jaccard FROM x")
def _(spark, d):
    e = edges(spark, d)
    a, b = (A.neighbours(e, 20, s, weight=w).groupBy("entity").agg(F.collect_list("tx_id").alias(n)) for s, w, n in ((1, None, "a"), (2, "w", "b")))
    return a.join(b, "entity", "full_outer").select("entity", M.jaccard(F.coalesce("a", F.array().cast("array<long>")), F.coalesce("b", F.array().cast("array<long>"))).alias("jaccard"))


@query("mod11_permuted_block", f"WITH {EV} SELECT a.tx_id, a.user_key, b.amount, b.merchant_key FROM (SELECT *, row_number() OVER (ORDER BY tx_id) AS r FROM ev) a JOIN (SELECT *, row_number() OVER (ORDER BY {U.format("'31|' || tx_id")}, tx_id) AS r FROM ev) b USING (r)")
def _(spark, d):
    return A.permuted_block(tx_events(spark, d).select("tx_id", "user_key", "amount", "merchant_key"), ["amount", "merchant_key"], 31)
