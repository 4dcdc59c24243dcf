"""Rules that need no oracle: slow twins, permutations, leaks, distributions, failures."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.operators import encoders, graph, history, metrics, model, projections, sampling, splits
from txloom.sources import raw, sinks
from txloom.sources.fixtures import chronological_id, seconds


@pytest.fixture(scope="module")
def hourly(spark):
    """Hourly rows with pairs of equal times."""
    start = datetime(2020, 1, 1)
    rows = [(i, i % 7, i % 5, float(10 + i % 19) * (-1 if i % 17 == 0 else 1), start + timedelta(hours=i // 2), int(i % 9 == 0)) for i in range(180)]
    df = spark.createDataFrame(rows, "tx_id long, user_key long, merchant_key long, amount double, ts timestamp_ntz, label int")
    return df.withColumn("sec", seconds())


def test_history_equals_loops(hourly):
    rows = hourly.orderBy("tx_id").toPandas()
    got = history.entity_features(hourly, "user_key", "u").orderBy("tx_id").toPandas()
    for i, r in rows.iterrows():
        past = rows[(rows.user_key == r.user_key) & (rows.sec < r.sec)]
        x = np.sign(past.amount) * np.log1p(past.amount.abs())
        own = math.copysign(math.log1p(abs(r.amount)), r.amount)
        assert got.u_cold_start[i] == int(past.empty)
        assert got.u_prior_count_log[i] == pytest.approx(math.log1p(len(past)) / 10)
        assert got.u_count_24h_log[i] == pytest.approx(math.log1p((past.sec >= r.sec - 86_400).sum()) / 5)
        assert got.u_amount_log_delta[i] == pytest.approx(0 if past.empty else np.clip(own - x.mean(), -10, 10) / 5)
        assert got.u_amount_log_z[i] == pytest.approx(0 if past.empty else np.clip((own - x.mean()) / math.sqrt(max(x.var(ddof=0), 0.25)), -10, 10) / 5)


def test_future_and_labels_cannot_leak(hourly):
    cut = 120
    features = lambda d: [r for r in history.entity_features(d, "user_key", "u").drop("label", "amount").orderBy("tx_id").collect() if r.tx_id < cut]
    changed = hourly.withColumn("amount", F.when(F.col("tx_id") >= cut, 999.0).otherwise(F.col("amount"))).withColumn("label", 1 - F.col("label"))
    assert features(hourly) == features(changed)


def test_order_of_input_does_not_matter(hourly):
    a = history.rhythm_features(hourly, "user_key", "u").orderBy("tx_id").collect()
    b = history.rhythm_features(hourly.orderBy(F.col("tx_id").desc()).repartition(7), "user_key", "u").orderBy("tx_id").collect()
    assert a == b


def test_tie_safe_split_keeps_ties_together(hourly):
    s = splits.tie_safe_split(hourly)
    assert s.groupBy("ts").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()


def test_chronological_id_is_gapless(spark):
    rows = [(datetime(2020, 1, 1 + i % 3), i) for i in range(50)]
    got = chronological_id(spark.createDataFrame(rows, "ts timestamp_ntz, k int"), ["k"]).orderBy("ts", "k").select("tx_id").collect()
    assert [r[0] for r in got] == list(range(50))


def test_gumbel_draws_follow_plackett_luce(spark):
    edges = spark.createDataFrame([(1, i, float(w)) for i, w in ((0, 1), (1, 2), (2, 4))], "entity long, tx_id long, w double")
    got = {r.tx_id: r.inclusion for r in sampling.inclusion(edges, 2500, 2, 3, weight="w").collect()}
    w = {0: 1, 1: 2, 2: 4}
    want = {i: w[i] / 7 + sum(w[j] / 7 * w[i] / (7 - w[j]) for j in w if j != i) for i in w}
    assert all(abs(got[i] - want[i]) < 0.025 for i in w)


def test_small_groups_are_taken_whole_and_hubs_are_cut(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1000)] + [(1, 1000), (1, 1001)], "entity long, tx_id long")
    counts = {r.entity: r["count"] for r in sampling.neighbours(edges, 7, 1).groupBy("entity").count().collect()}
    assert counts == {0: 7, 1: 2}


def test_closed_form_pagerank_equals_steps(hourly):
    a = {(r.user_key, r.tx_id): r.ppr for r in graph.ppr_by_steps(hourly).collect()}
    b = {(r.user_key, r.tx_id): r.x for r in graph.with_degrees(hourly).select("user_key", "tx_id", graph.ppr_weight("d_u", "d_m").alias("x")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_undersampling_that_is_not_feasible_fails(hourly):
    with pytest.raises(ValueError, match="too few"):
        graph.undersample_ratio(hourly, 0.01, F.rand(1))


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(i, i / 10, 0) for i in range(10)], "tx_id long, score double, label int")
    assert metrics.average_precision(df).first().ap is None and metrics.roc_auc(df).first().auc is None
    assert metrics.top_share(df, 0.2, "half_even").first().lift is None


def test_mcnemar_and_holm(spark):
    df = spark.createDataFrame([("a", 1, 1, 0)] * 8 + [("a", 1, 0, 1)] * 1 + [("b", 1, 1, 0)] * 3 + [("b", 1, 0, 1)] * 3, "g string, label int, x int, y int")
    got = {r.g: r for r in metrics.holm(metrics.mcnemar(df, ["g"], "x", "y").withColumn("c", F.lit(1)), "p", ["c"], "g").collect()}
    p = 2 * sum(math.comb(9, k) for k in range(2)) / 2**9
    assert got["a"].p == pytest.approx(p) and got["a"].adjusted == pytest.approx(2 * p) and got["b"].p == pytest.approx(1.0) and got["b"].adjusted == pytest.approx(1.0)


def test_jaccard_of_nothing_is_one(spark):
    e = F.array().cast("array<long>")
    assert spark.range(1).select(metrics.jaccard(e, e).alias("j")).first().j == 1.0


def test_bad_rows_fail_the_load(spark):
    df = spark.createDataFrame([(None, 1, "u", "m")], "ts timestamp_ntz, label int, user_key string, merchant_key string")
    with pytest.raises(ValueError, match="invalid_ts"):
        projections.checked(df)


def test_long_ids_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(c for c in raw.REQUIRED) + "\n" + '1,2020,1,2,6:05,"$1,234.50",Swipe Transaction,-9223372036854775807,ONLINE,,,5411,,Yes\n' + "2,2020,1,2,bad,x,Chip Transaction,5,Rome,Italy,,5411,Bad PIN,No\n")
    rows = projections.parsed(raw.csv(spark, str(tmp_path))).orderBy("source_row").collect()
    assert rows[0].merchant_key == "-9223372036854775807" and rows[0].amount == 1234.5 and rows[0].card_key == "<missing>" and rows[0].ts == datetime(2020, 1, 2, 6, 5)
    assert rows[1].ts is None and rows[1].amount is None and rows[1].label == 0


def test_one_hot_guard_and_oov(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    got = encoders.one_hot(train, spark.createDataFrame([("z",), (None,), ("a",)], "c string"), "c").collect()
    assert [tuple(r[1:]) for r in got] == [(0, 0, 1, 0), (0, 0, 0, 1), (1, 0, 0, 0)]
    with pytest.raises(ValueError, match="over 1"):
        encoders.one_hot(train, train, "c", most=1)


def test_factorised_forward_equals_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(12, 3)).astype(np.float32)
    near = {e: [t for t in range(12) if t % 3 == e] for e in range(3)}
    w = model.sage_weights(3, 4)
    features = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(12)], "tx_id long, x array<float>")
    nb = spark.createDataFrame([(e, t) for e, ts in near.items() for t in ts], "entity long, tx_id long")
    roots = spark.createDataFrame([(t, t % 3) for t in range(12)], "tx_id long, entity long")
    got = {q.tx_id: q.logit for q in model.factorised_scores(roots, nb, features, w).collect()}
    for t in range(12):
        m = x[near[t % 3]].mean(0, keepdims=True)
        h = model.layer(x, np.repeat(m, 12, 0), w["self1"], w["near1"])
        assert got[t] == pytest.approx(float((model.layer(h[t : t + 1], h[near[t % 3]].mean(0, keepdims=True), w["self2"], w["near2"]) @ w["head"])[0, 0]), abs=1e-4)


def test_run_folder_states(tmp_path):
    with pytest.raises(RuntimeError), sinks.Run(tmp_path / "r"):
        raise RuntimeError("broken")
    run = sinks.Run(tmp_path / "r")
    assert run.status()["status"] == "failed"
    with run:
        pass
    assert run.status() == {"attempts": 2, "status": "complete"}
    with pytest.raises(ValueError, match="complete"), run:
        pass


def test_row_identity_ignores_order(hourly):
    a = sinks.row_identity(hourly, ["tx_id", "amount"]).first()
    assert a == sinks.row_identity(hourly.orderBy(F.col("tx_id").desc()).repartition(5), ["tx_id", "amount"]).first()
    assert a != sinks.row_identity(hourly.withColumn("amount", F.col("amount") + 1), ["tx_id", "amount"]).first()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_read_all_rows(spark, sf_dir):
    from txloom.plans import q_metrics, q_relational, registry
    from txloom.sources.fixtures import transactions

    n = transactions(spark, sf_dir).count()
    assert registry.QUERIES["mod3_causal_forward"](spark, sf_dir).count() == n
    assert q_relational.runs(spark, sf_dir, whole=True)[1].count() == q_metrics._discordant(spark, sf_dir, whole=True).count() == n
    pairs = q_metrics.M.mcnemar(q_metrics._discordant(spark, sf_dir, whole=True), ["channel", "state_key"], "a", "b")
    want = q_metrics.M.holm(pairs, "p", ["channel"], "state_key")
    assert registry.QUERIES["met28_mcnemar_holm"](spark, sf_dir).count() == want.count() > 0
    assert registry.QUERIES["met26_block_bootstrap"](spark, sf_dir).count() > 0
