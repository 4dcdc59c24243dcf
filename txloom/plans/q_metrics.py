"""Queries over ranking metrics and paired statistics (MET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.fixtures import EV, SCORED, U, scored, table, transactions, uniform
from .q_relational import _RUNS, runs
from .registry import query

CONF = "count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label = 0) AS fp, count(*) FILTER (score < 0.6 AND label = 1) AS fn, count(*) FILTER (score < 0.6 AND label = 0) AS tn"
CURVE = f"{SCORED}, c AS (SELECT channel, score, count(*) AS n, sum(label)::BIGINT AS p FROM sc GROUP BY ALL), k AS (SELECT *, (sum(p) OVER w)::DOUBLE AS tp, (sum(n) OVER w)::DOUBLE AS seen, (sum(p) OVER (PARTITION BY channel))::DOUBLE AS ap FROM c WINDOW w AS (PARTITION BY channel ORDER BY score DESC))"
RANK = f"{SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, tx_id) AS rank, count(*) OVER (PARTITION BY channel) AS n, (sum(label) OVER (PARTITION BY channel))::DOUBLE AS p FROM sc)"


def rows(spark, d):  # noqa: ANN001, ANN201
    return scored(transactions(spark, d))


@query("met1_confusion", f"WITH {SCORED} SELECT channel, {CONF} FROM sc GROUP BY channel")
def _(spark, d):
    return M.confusion(rows(spark, d), 0.6, ["channel"])


_RATES = "tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tn / nullif(tn + fp, 0) AS s"


@query("met2_rates", f"WITH {SCORED}, c AS (SELECT channel, {CONF} FROM sc GROUP BY channel), x AS (SELECT *, {_RATES}, tp + fp + fn + tn AS n FROM c) SELECT channel, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1_macro, round(s, 6) AS specificity, round(fp / (fp + tn), 6) AS fpr, round(sqrt(r * s), 6) AS g_mean, round((tp + tn) / n, 6) AS accuracy, round((tp + fp) / n, 6) AS alert_rate, round((tp + fn) / n, 6) AS prevalence, round((tp + fp) / nullif(tp, 0), 6) AS alerts_per_fraud FROM x")
def _(spark, d):
    return M.rates(M.confusion(rows(spark, d), 0.6, ["channel"]))


@query("met3_average_precision", f"WITH {CURVE} SELECT channel, round(sum(p * tp / seen) / nullif(sum(p), 0), 6) AS ap FROM k GROUP BY channel")
def _(spark, d):
    return M.average_precision(rows(spark, d), ["channel"])


@query("met4_roc_auc", f"WITH {CURVE} SELECT channel, round(sum((n - p) * (tp - p + p / 2)) / nullif(sum(p) * sum(n - p), 0), 6) AS auc FROM k GROUP BY channel")
def _(spark, d):
    return M.roc_auc(rows(spark, d), ["channel"])


@query("met5_pr_curve", f"WITH {CURVE} SELECT channel, score, tp::BIGINT AS tp, seen::BIGINT AS seen, round(tp / seen, 6) AS precision, round(tp / ap, 6) AS recall FROM k")
def _(spark, d):
    return M.pr_curve(rows(spark, d), ["channel"])


@query("met6_map", f"WITH {RANK}, h AS (SELECT channel, label, rank, sum(label) OVER (PARTITION BY channel ORDER BY rank) AS tp FROM k), a AS (SELECT channel, avg(tp / rank) AS ap FROM h WHERE label = 1 GROUP BY channel) SELECT round(avg(ap), 6) AS map, count(*) AS groups FROM a")
def _(spark, d):
    return M.mean_average_precision(rows(spark, d), ["channel"])


@query("met7_ndcg", f"WITH {RANK}, i AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY label DESC, rank) AS ideal FROM k) SELECT channel, round(sum(CASE WHEN rank <= 200 THEN (2 ** label - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 200 THEN (2 ** label - 1) / log2(ideal + 1) ELSE 0 END), 0), 6) AS ndcg FROM i GROUP BY channel")
def _(spark, d):
    return M.ndcg(rows(spark, d), ["channel"], 200)


for _rule, _k in (("half_even", "nullif(round_even(n * 0.01::DOUBLE, 0)::BIGINT, 0)"), ("at_least_one", "greatest(round_even(n * 0.01::DOUBLE, 0)::BIGINT, 1)"), ("ceil", "ceil(n * 0.01::DOUBLE)::BIGINT")):

    @query(f"met8_lift_{_rule}", f"WITH {RANK}, q AS (SELECT *, {_k} AS k FROM k), x AS (SELECT channel, max(k) AS k, sum(CASE WHEN rank <= k THEN label ELSE 0 END)::BIGINT AS tp, max(p) AS p, count(*) AS n FROM q GROUP BY channel) SELECT channel, k, tp, round(tp / k, 6) AS precision, round(tp / k / (p / n), 6) AS lift, round(tp / p, 6) AS recall FROM x")
    def _(spark, d, rule=_rule):  # noqa: ANN001, ANN202
        return M.top_share(rows(spark, d), 0.01, rule, ["channel"])


@query("met9_budgets", f"WITH {RANK}, x AS (SELECT channel, b::INT AS k, sum(CASE WHEN rank <= b THEN label ELSE 0 END)::BIGINT AS tp, max(p) AS p, max(n) AS n FROM k, (VALUES (100), (250), (500), (1000)) v(b) GROUP BY ALL) SELECT channel, k, tp, round(tp / least(k, n), 6) AS precision, round(tp / p, 6) AS recall FROM x")
def _(spark, d):
    return M.at_budgets(rows(spark, d), [100, 250, 500, 1000], ["channel"])


@query("met10_quota", f"WITH {RANK}, q AS (SELECT *, greatest(floor(n * 0.005::DOUBLE)::BIGINT, 1) AS k FROM k), x AS (SELECT channel, max(k) AS k, sum(CASE WHEN rank <= k THEN label ELSE 0 END)::BIGINT AS tp, max(p) AS p, count(*) AS n FROM q GROUP BY channel) SELECT channel, k, tp, round(tp / k, 6) AS precision, round(tp / k / (p / n), 6) AS lift, round(tp / p, 6) AS recall FROM x")
def _(spark, d):
    return M.top_share(rows(spark, d), 0.005, "floor", ["channel"])


@query("met11_best_f_beta", f"WITH {CURVE}, f AS (SELECT channel, score, coalesce(5 * (tp / seen) * (tp / ap) / nullif(4 * (tp / seen) + tp / ap, 0), 0) AS f FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY f DESC, score DESC) AS r FROM f) SELECT channel, score AS threshold, round(f, 6) AS f FROM r WHERE r = 1")
def _(spark, d):
    return M.best_f(rows(spark, d), 2.0, by=["channel"])


@query("met12_min_precision_f1", f"WITH {CURVE}, f AS (SELECT channel, score, tp / seen >= 0.3 AS good, coalesce(2 * (tp / seen) * (tp / ap) / nullif(tp / seen + tp / ap, 0), 0) AS f FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY good DESC, f DESC, score) AS r FROM f) SELECT channel, score AS threshold, round(f, 6) AS f FROM r WHERE r = 1")
def _(spark, d):
    return M.best_f(rows(spark, d), 1.0, 0.3, largest=False, by=["channel"])


_GRID = [i / 200 for i in range(4, 151)]


@query("met13_grid_scan", f"WITH {SCORED}, g AS (SELECT i / 200.0::DOUBLE AS t FROM range(4, 151) r(i)), x AS (SELECT t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn FROM sc, g GROUP BY t) SELECT t AS threshold, round(2 * tp / (2 * tp + fp + fn), 6) AS f FROM x ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, t LIMIT 1")
def _(spark, d):
    g = M.rates(M.grid(rows(spark, d), _GRID))
    return g.agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("x")).select((-F.col("x.t")).alias("threshold"), F.col("x.f1").alias("f"))


@query("met14_fpr_budget", f"WITH {SCORED}, c AS (SELECT score, count(*) AS n FROM sc WHERE label = 0 GROUP BY score), k AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS seen, sum(n) OVER () AS a FROM c) SELECT max(score) AS cutoff FROM k WHERE seen > floor(a * 0.05)")
def _(spark, d):
    return M.fpr_budget(rows(spark, d), 0.05)


@query("met15_threshold_curve", f"WITH {SCORED}, g AS (SELECT i / 200.0::DOUBLE AS t FROM range(10, 191) r(i)) SELECT t AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, count(*) FILTER (score < t AND label = 0) AS tn FROM sc, g GROUP BY t")
def _(spark, d):
    return M.grid(rows(spark, d), [i / 200 for i in range(10, 191)])


@query("met16_monthly_ap", f"WITH {SCORED}, c AS (SELECT strftime(ts, '%Y-%m') AS month, score, count(*) AS n, sum(label) AS p FROM sc WHERE channel = 'P' GROUP BY ALL), k AS (SELECT month, p, sum(p) OVER w / sum(n) OVER w AS prec FROM c WINDOW w AS (PARTITION BY month ORDER BY score DESC)) SELECT month, round(sum(p * prec) / nullif(sum(p), 0), 6) AS ap FROM k GROUP BY month")
def _(spark, d):
    return M.average_precision(rows(spark, d).filter("channel = 'P'").withColumn("month", F.date_format("ts", "yyyy-MM")), ["month"])


_HIST = f"{SCORED}, h AS (SELECT *, count(*) OVER (PARTITION BY user_key) AS du, count(*) OVER (PARTITION BY merchant_key) AS dm FROM sc)"


@query("met17_degree_strata", f"WITH {_HIST}, x AS (SELECT 'user' AS axis, du AS d, * FROM h UNION ALL SELECT 'merchant', dm, * FROM h), z AS (SELECT axis, CASE WHEN d <= 15 THEN 'low' WHEN d <= 200 THEN 'medium' ELSE 'high' END AS stratum, score, label FROM x) SELECT axis, stratum, {CONF} FROM z GROUP BY ALL")
def _(spark, d):
    t = rows(spark, d)
    deg = lambda k: F.count("*").over(Window.partitionBy(k))
    axes = F.array(F.struct(F.lit("user").alias("axis"), F.col("du").alias("d")), F.struct(F.lit("merchant").alias("axis"), F.col("dm").alias("d")))
    each = t.withColumns({"du": deg("user_key"), "dm": deg("merchant_key")}).select("score", "label", F.explode(axes).alias("e"))
    return M.confusion(each.select("score", "label", "e.axis", M.degree_strata(F.col("e.d")).alias("stratum")), 0.6, ["axis", "stratum"])


@query("met18_quartile_strata", f"WITH {_HIST}, q AS (SELECT *, row_number() OVER (ORDER BY du, tx_id) AS r, count(*) OVER () AS n, quantile_cont(du, 0.99) OVER () AS hub FROM h), z AS (SELECT ((r > 1 + (n - 1) / 4)::INT + (r > 1 + 2 * (n - 1) / 4)::INT + (r > 1 + 3 * (n - 1) / 4)::INT) AS bin, (du >= hub)::INT AS super_hub, score, label FROM q) SELECT bin, super_hub, {CONF} FROM z GROUP BY ALL")
def _(spark, d):
    from ..operators.history import rank_quartiles

    t = rows(spark, d).withColumn("du", F.count("*").over(Window.partitionBy("user_key")))
    hub = F.broadcast(t.agg(F.percentile("du", 0.99).alias("hub")))
    z = rank_quartiles(t, "du", ["tx_id"]).crossJoin(hub).withColumn("super_hub", (F.col("du") >= F.col("hub")).cast("int"))
    return M.confusion(z, 0.6, ["bin", "super_hub"])


_THREE = f"{SCORED}, f AS (SELECT tx_id, (score >= 0.6)::INT::VARCHAR || ({U.format("'a|' || tx_id")} >= 0.5)::INT::VARCHAR || ({U.format("'b|' || tx_id")} >= 0.7)::INT::VARCHAR AS pattern FROM sc WHERE label = 1)"


@query("met19_capture_overlap", f"WITH {_THREE}, dom AS (SELECT a || b || c AS pattern FROM (VALUES ('0'), ('1')) x(a), (VALUES ('0'), ('1')) y(b), (VALUES ('0'), ('1')) z(c)) SELECT dom.pattern, count(tx_id) AS fraud FROM dom LEFT JOIN f USING (pattern) GROUP BY dom.pattern")
def _(spark, d):
    from ..operators.relational import on_domain

    bit = lambda c: c.cast("int").cast("string")
    pattern = F.concat(bit(F.col("score") >= 0.6), bit(uniform(F.lit("a"), "tx_id") >= 0.5), bit(uniform(F.lit("b"), "tx_id") >= 0.7))
    counts = rows(spark, d).filter("label = 1").groupBy(pattern.alias("pattern")).agg(F.count("*").alias("fraud"))
    domain = spark.range(8).select(F.lpad(F.bin("id"), 3, "0").alias("pattern"))
    return on_domain(counts, domain, ["pattern"])


@query("met20_case_analysis", f"WITH {_RUNS}, j AS (SELECT ra.tx_id, ra.label, ra.score AS a, rb.score AS b FROM ra JOIN rb USING (tx_id)) SELECT tx_id, ((a >= 0.5) <> (label = 1) AND (b >= 0.5) <> (label = 1))::INT AS consistent_wrong, ((a >= 0.5) <> (b >= 0.5))::INT AS switched, round(greatest(a, b) - least(a, b), 6) AS range FROM j")
def _(spark, d):
    from ..operators.relational import paired

    j = paired(*runs(spark, d), "tx_id")
    a, b, y = F.col("score_a") >= 0.5, F.col("score_b") >= 0.5, F.col("label_a") == 1
    return j.select("tx_id", ((a != y) & (b != y)).cast("int").alias("consistent_wrong"), (a != b).cast("int").alias("switched"), (F.greatest("score_a", "score_b") - F.least("score_a", "score_b")).alias("range"))


@query("met22_edge_audit", f"WITH {SCORED}, e AS (SELECT a.tx_id AS root, a.label AS rl, b.tx_id, b.label FROM sc a JOIN sc b USING (user_key)) SELECT count(*) AS edges, round(avg((root = tx_id)::INT), 6) AS self_edges, round(avg((rl = label)::INT) FILTER (root <> tx_id), 6) AS homophily, round(avg(label) FILTER (root <> tx_id) / (SELECT avg(label) FROM sc), 6) AS fraud_lift FROM e")
def _(spark, d):
    t = rows(spark, d)
    roots = t.select("user_key", F.col("tx_id").alias("root"), F.col("label").alias("rl"))
    e = t.select("user_key", "tx_id", "label").join(roots, "user_key")
    other = F.col("root") != F.col("tx_id")
    base = F.broadcast(t.agg(F.avg("label").alias("base")))
    out = e.agg(F.count("*").alias("edges"), F.avg((~other).cast("double")).alias("self_edges"), F.avg(F.when(other, (F.col("rl") == F.col("label")).cast("double"))).alias("homophily"), F.avg(F.when(other, F.col("label"))).alias("f"))
    return out.crossJoin(base).select("edges", "self_edges", "homophily", (F.col("f") / F.col("base")).alias("fraud_lift"))


@query("met23_spearman", f"WITH {SCORED}, g AS (SELECT merchant_key, avg(score) AS a, count(*) AS b FROM sc GROUP BY ALL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM g) SELECT round(corr(ra, rb), 6) AS rho FROM r")
def _(spark, d):
    g = rows(spark, d).groupBy("merchant_key").agg(F.avg("score").alias("a"), F.count("*").alias("b"))
    return M.spearman(g, "a", "b")


_LONG = f"{EV}, l AS (SELECT user_key, channel AS method, avg(amount) AS value FROM ev GROUP BY ALL)"


@query("met24_paired_deltas", f"WITH {_LONG}, j AS (SELECT a.method AS a, b.method AS b, b.value - a.value AS d FROM l a JOIN l b USING (user_key) WHERE a.method < b.method) SELECT a, b, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(quantile_cont(d, 0.5), 6) AS median, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses FROM j GROUP BY ALL")
def _(spark, d):
    from ..sources.fixtures import tx_events

    long = tx_events(spark, d).groupBy("user_key", F.col("channel").alias("method")).agg(F.avg("amount").alias("value"))
    return M.paired_deltas(long, "user_key", "method", "value")


_POISSON = " + ".join(f"(u >= {sum(2.718281828459045**-1 / __import__('math').factorial(i) for i in range(k + 1))!r}::DOUBLE)::INT" for k in range(8))


@query("met25_bootstrap_mean", f"WITH {EV}, g AS (SELECT user_key, sum(amount) AS s, count(*) AS n FROM ev GROUP BY ALL), w AS (SELECT draw, s, n, {U.format("'25|' || draw || '|' || user_key")} AS u FROM g, range(1, 201) d(draw)), m AS (SELECT draw, sum(({_POISSON}) * s) / sum(({_POISSON}) * n) AS m FROM w GROUP BY draw) SELECT round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m")
def _(spark, d):
    from ..sources.fixtures import tx_events

    return M.bootstrap_mean(tx_events(spark, d), "amount", "user_key", 200, 25).select(*(F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")))


@query("met26_block_bootstrap")
def _(spark, d):
    from ..operators.relational import paired

    a, b = runs(spark, d)
    days = transactions(spark, d).select("tx_id", F.to_date("ts").alias("day"))
    j = paired(a, b, "tx_id").join(days, "tx_id").withColumn("delta", F.col("score_b") - F.col("score_a"))
    return M.bootstrap_mean(j, "delta", "day", 200, 26)


@query("met27_hierarchical_bootstrap")
def _(spark, d):
    """Seeds and days are drawn together; average precision is worked out anew on each draw's weights."""
    t = rows(spark, d).select((F.col("user_key") % 3).alias("seed"), F.date_format("ts", "yyyy-MM").alias("day"), "score", "label")
    cells = t.groupBy("seed", "day", "score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    each = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(50))))
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    weight = lambda u: sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    w = weight(uniform(27, "draw", "seed", "day")) * weight(uniform(28, "draw", "seed"))
    by_score = each.withColumn("w", w).groupBy("draw", "score").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("p")).alias("p"))
    win = Window.partitionBy("draw").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.withColumns({"tp": F.sum("p").over(win), "seen": F.sum("n").over(win)})
    ap = run.groupBy("draw").agg((F.sum(F.when(F.col("seen") > 0, F.col("p") * F.col("tp") / F.col("seen"))) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))
    return ap.agg(F.avg("ap").alias("mean"), F.percentile("ap", 0.025).alias("lo"), F.percentile("ap", 0.975).alias("hi"))


def _discordant(spark, d, whole=True):  # noqa: ANN001, ANN202
    from ..operators.relational import paired

    j = paired(*runs(spark, d, whole), "tx_id").join(transactions(spark, d).select("tx_id", "channel", "state_key"), "tx_id")
    return j.select("channel", "state_key", F.col("label_a").alias("label"), (F.col("score_a") >= 0.5).cast("int").alias("a"), (F.col("score_b") >= 0.5).cast("int").alias("b"))


@query("met28_mcnemar_counts", f"WITH {_RUNS}, j AS (SELECT channel, state_key, ra.label, (ra.score >= 0.5)::INT AS a, (rb.score >= 0.5)::INT AS b FROM ra JOIN rb USING (tx_id) JOIN tx USING (tx_id)) SELECT channel, state_key, count(*) FILTER (a = label AND b <> label) AS only_a, count(*) FILTER (a <> label AND b = label) AS only_b FROM j GROUP BY ALL")
def _(spark, d):
    return M.mcnemar(_discordant(spark, d), ["channel", "state_key"], "a", "b").drop("p")


@query("met28_mcnemar_holm")
def _(spark, d):
    return M.holm(M.mcnemar(_discordant(spark, d), ["channel", "state_key"], "a", "b"), "p", ["channel"], "state_key")


@query("met29_daily_delta", f"WITH {_RUNS}, j AS (SELECT ts::DATE::VARCHAR AS day, ra.score AS a, rb.score AS b FROM ra JOIN rb USING (tx_id) JOIN tx USING (tx_id)) SELECT day, count(*) AS rows, round(avg(b) - avg(a), 6) AS delta FROM j GROUP BY day")
def _(spark, d):
    from ..operators.relational import paired

    j = paired(*runs(spark, d), "tx_id").join(transactions(spark, d).select("tx_id", F.to_date("ts").alias("day")), "tx_id")
    return j.groupBy("day").agg(F.count("*").alias("rows"), (F.avg("score_b") - F.avg("score_a")).alias("delta"))


_DIM = "SELECT unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS x, (label = 0)::INT AS y FROM embeddings"


@query("met30_fisher_ratio", f"WITH e AS ({_DIM}) SELECT dim::INT AS dim, round((avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) ** 2, 6) AS distance, round((avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) ** 2 / (var_pop(x) FILTER (y = 1) + var_pop(x) FILTER (y = 0) + 1e-12), 6) AS fisher FROM e GROUP BY dim")
def _(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") == 0).alias("y"), F.posexplode("embedding").alias("dim", "x")).select("y", (F.col("dim") + 1).alias("dim"), F.col("x").cast("double").alias("x"))
    pos, neg = (lambda f: f(F.when(F.col("y"), F.col("x")))), (lambda f: f(F.when(~F.col("y"), F.col("x"))))
    gap = F.pow(pos(F.avg) - neg(F.avg), F.lit(2.0))
    return e.groupBy("dim").agg(gap.alias("distance"), (gap / (pos(F.var_pop) + neg(F.var_pop) + 1e-12)).alias("fisher"))


@query("met31_long_tail_recall", f"WITH {_HIST} SELECT count(*) FILTER (label = 1) AS fraud, round(count(*) FILTER (label = 1 AND score >= 0.6) / nullif(count(*) FILTER (label = 1), 0), 6) AS recall FROM h WHERE du <= 45")
def _(spark, d):
    t = rows(spark, d).withColumn("du", F.count("*").over(Window.partitionBy("user_key"))).filter("du <= 45")
    return t.agg(F.count(F.when(F.col("label") == 1, 1)).alias("fraud"), M.ratio(F.count(F.when((F.col("label") == 1) & (F.col("score") >= 0.6), 1)), F.count(F.when(F.col("label") == 1, 1))).alias("recall"))


@query("met32_neighbour_age", f"WITH {SCORED}, r AS (SELECT tx_id AS root, merchant_key, ts::DATE AS day FROM sc WHERE label = 1), e AS (SELECT root, day - ts::DATE AS age FROM r JOIN sc USING (merchant_key) WHERE ts::DATE < day) SELECT round(quantile_cont(age, 0.5), 6) AS median, round(quantile_cont(age, 0.9), 6) AS p90, round(avg((age <= 180)::INT), 6) AS recent, round((SELECT avg((root NOT IN (SELECT root FROM e))::INT) FROM r), 6) AS cold FROM e")
def _(spark, d):
    t = rows(spark, d)
    r = t.filter("label = 1").select(F.col("tx_id").alias("root"), "merchant_key", F.to_date("ts").alias("day"))
    e = r.join(t.select("merchant_key", F.to_date("ts").alias("d")), "merchant_key").filter("d < day").select("root", F.datediff("day", "d").alias("age"))
    cold = r.join(e.select("root").distinct().withColumn("warm", F.lit(1)), "root", "left").agg(F.avg(F.col("warm").isNull().cast("double")).alias("cold"))
    return e.agg(F.percentile("age", 0.5).alias("median"), F.percentile("age", 0.9).alias("p90"), F.avg((F.col("age") <= 180).cast("double")).alias("recent")).crossJoin(F.broadcast(cold))


@query("met33_research_gate", f"WITH {_LONG}, j AS (SELECT b.value - a.value AS d FROM l a JOIN l b USING (user_key) WHERE a.method = 'click' AND b.method = 'view') SELECT (count(*) >= 3)::INT AS enough, (avg(d) > 0)::INT AS better, (quantile_cont(d, 0.5) > 0)::INT AS median_better, (avg((d > 0)::INT) >= 0.6)::INT AS mostly, (min(d) > -50)::INT AS no_collapse FROM j")
def _(spark, d):
    from ..sources.fixtures import tx_events

    long = tx_events(spark, d).groupBy("user_key", F.col("channel").alias("method")).agg(F.avg("amount").alias("value"))
    a, b = (long.filter(F.col("method") == m).select("user_key", F.col("value").alias(n)) for m, n in (("click", "a"), ("view", "b")))
    x = a.join(b, "user_key").withColumn("d", F.col("b") - F.col("a"))
    gate = {"enough": F.count("*") >= 3, "better": F.avg("d") > 0, "median_better": F.percentile("d", 0.5) > 0, "mostly": F.avg((F.col("d") > 0).cast("double")) >= 0.6, "no_collapse": F.min("d") > -50}
    return x.agg(*(c.cast("int").alias(n) for n, c in gate.items()))


@query("met34_controlled_comparison", "SELECT o_orderpriority AS run, count(DISTINCT o_orderstatus) AS ids, (count(DISTINCT o_orderstatus) = 1)::INT AS controlled FROM orders GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.countDistinct("o_orderstatus").alias("ids")).withColumn("controlled", (F.col("ids") == 1).cast("int"))


@query("met35_alerts_per_fraud", f"WITH {SCORED} SELECT state_key, round(count(*) FILTER (score >= 0.6) / nullif(count(*) FILTER (score >= 0.6 AND label = 1), 0), 6) AS alerts FROM sc GROUP BY ALL")
def _(spark, d):
    return M.rates(M.confusion(rows(spark, d), 0.6, ["state_key"])).select("state_key", F.col("alerts_per_fraud").alias("alerts"))
