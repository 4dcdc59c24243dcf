"""Replay over many partitions and restarts, ranks without a one-task window, recursions, flat JSON, model rows against plain versions."""

import hashlib
import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.functions import checkpoints, ranks
from txloom.operators import encoders, graph, history, model, sampling, splits
from txloom.sources import raw
from txloom.sources.fixtures import seconds, transactions
from txloom.streaming import replay


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def daily(spark):
    start = datetime(2021, 1, 1)
    rows = [(i, i % 5 if i % 50 else None, float(i % 13), start + timedelta(days=i // 2, hours=i % 3)) for i in range(400)]
    return spark.createDataFrame(rows, "tx_id long, user_key long, amount double, ts timestamp_ntz").withColumn("sec", seconds())


def plain_replay(rows):
    out = {}
    for r in rows:
        past = [q.amount for q in rows if q.user_key == r.user_key and q.ts.date() < r.ts.date()]
        out[r.tx_id] = (len(past), pytest.approx(np.mean(past) if past else 0.0))
    return out


def test_replay_is_causal_whatever_the_partitions(spark, daily, tmp_path, many_partitions):
    got = replay.replay(spark, daily.repartition(8), "user_key", str(tmp_path), days_in_batch=7).collect()
    assert {r.tx_id: (r.degree, r["mean"]) for r in got} == plain_replay(daily.collect()) and len(got) == 400


def test_replay_goes_on_after_a_restart(spark, daily, tmp_path, many_partitions):
    def broken(k):
        if k == 3:
            raise RuntimeError("the driver is gone")

    with pytest.raises(Exception, match="the driver is gone"):
        replay.replay(spark, daily, "user_key", str(tmp_path), "r", 20, broken)
    seen = []
    got = replay.replay(spark, daily, "user_key", str(tmp_path), "r", 20, seen.append).collect()
    assert seen == list(range(3, 10))
    assert {r.tx_id: (r.degree, r["mean"]) for r in got} == plain_replay(daily.collect()) and len(got) == 400


def test_replay_of_nothing(spark, daily, tmp_path):
    assert replay.replay(spark, daily.limit(0), "user_key", str(tmp_path)).count() == 0


def test_days_that_are_not_newer_are_an_error(spark, daily):
    with pytest.raises(ValueError, match="newer"):
        replay.checked_append("2021-01-05", daily)


def test_global_ranks(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(0, 1 << 20)), float(r.random()), "ab"[i % 2] if i % 9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "tx_id long, k long, u double, g string").repartition(5)
    by_key = {q.tx_id: q.r for q in ranks.global_rank(df, ranks.of_key("k"), ["k", "tx_id"], "r").collect()}
    assert by_key == {t[0]: i + 1 for i, t in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    by_draw = {q.tx_id: q.r for q in ranks.global_rank(df, ranks.of_draw(F.col("u")), ["u"], "r", ["g"]).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {t[0]: i + 1 for i, t in enumerate(sorted((t for t in rows if t[3] == g), key=lambda t: t[2]))}
    assert by_draw == want


@pytest.mark.parametrize("name", ["undersample", "balanced", "stratified", "batches", "permuted", "tail", "source", "smoke"])
def test_ranks_have_partitions(spark, sf_dir, name):
    t = transactions(spark, sf_dir)
    u = F.rand(3)
    plans = {
        "undersample": lambda: graph.undersample_capped(t, 0.5, u), "balanced": lambda: sampling.balanced_roots(t, 2, 1, 1), "stratified": lambda: sampling.stratified_roots(t, ["channel"], 50, 1),
        "batches": lambda: sampling.batches(t, 100, "tx_id"), "permuted": lambda: sampling.permuted_block(t, ["amount"], 1), "tail": lambda: splits.selection_tail(t, 0.2, 5),
        "source": lambda: splits.source_order_split(t, "tx_id"), "smoke": lambda: splits.smoke_subset(t, 0.5, 10, u),
    }
    text = plans[name]()._jdf.queryExecution().optimizedPlan().toString()
    bare = [line for line in text.split("\n") if "Window [row_number" in line and "windowspecdefinition(_bucket" not in line and "windowspecdefinition(channel" not in line and "windowspecdefinition(_day" not in line]
    assert not bare, bare


@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.9, 1.0, 0.0])
def test_ema_equals_the_recursion(spark, alpha):
    r = np.random.default_rng(2)
    rows = [(g, i, float(x)) for g, n in (("a", 3000), ("b", 1), (None, 40)) for i, x in enumerate(r.normal(5, 100, n))]
    got = {(q.g, q.i): q.ema for q in history.ema(spark.createDataFrame(rows, "g string, i long, x double").repartition(4), ["g"], "i", "x", alpha).collect()}
    last = {}
    for g, i, x in rows:
        last[g] = x if i == 0 else last[g] * (1 - alpha) + x * alpha
        assert got[g, i] == pytest.approx(last[g], rel=1e-9, abs=1e-9)


def test_ema_after_a_null_is_null(spark):
    rows = [(1, 0, 2.0), (1, 1, None), (1, 2, 3.0), (2, 0, 4.0)]
    assert [q.ema for q in history.ema(spark.createDataFrame(rows, "g int, i long, x double"), ["g"], "i", "x").orderBy("g", "i").collect()] == [2.0, None, None, 4.0]


def test_flat_numbers_by_the_rules(spark):
    text = json.dumps({"a": {"b": [1, {"c": None}], "ok": True}, "n": float("nan"), "i": float("inf"), "s": "x", "e": []})
    got = {r.metric: r.value for r in raw.flat_numbers(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "t", ["k"]).collect()}
    assert got == {"a.b[0]": 1.0, "a.b[1].c": None, "n": None, "i": None}


def test_a_cluster_needs_a_named_folder():
    class Conf:
        get = staticmethod(lambda key, other: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="share"):
        checkpoints.shared_dir(Session)


def test_pagerank_equals_numpy(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(0, 9)), int(r.integers(0, 7))) for i in range(120)]
    got = {(q.side, q.entity): q["rank"] for q in graph.pagerank(spark.createDataFrame(rows, "tx_id long, user_key long, merchant_key long"), steps=7).collect()}
    nodes = sorted({("u", u) for _, u, _ in rows} | {("m", m) for _, _, m in rows})
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for _, u, m in rows:
        w[at["u", u], at["m", m]] += 1
        w[at["m", m], at["u", u]] += 1
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(7):
        rank = 0.15 / len(nodes) + 0.85 * (w / w.sum(1, keepdims=True)).T @ rank
    for side in "um":
        own = [n for n in nodes if n[0] == side]
        x = np.array([rank[at[n]] for n in own])
        for n, v in zip(own, (x - x.min()) / (x.max() - x.min()), strict=True):
            assert got[n] == pytest.approx(v, abs=1e-9)
    assert math.isclose(rank.sum(), 1)


def test_sparse_matrix_by_hand(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 5.0)], "c string, x double")
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 5.0), (2, "z", 3.0), (3, None, 3.0)], "tx_id int, c string, x double")
    got = {r.tx_id: r.v for r in encoders.sparse_matrix(train, df, ["c"], ["x"]).select("tx_id", vector_to_array("features").alias("v")).collect()}
    assert got == {0: [1.0, 0.0, 1.0], 1: [0.0, 1.0, 5.0], 2: [0.0, 0.0, 3.0], 3: [0.0, 0.0, 3.0]}


def test_spectral_sketch_equals_numpy(spark):
    from txloom.sources.fixtures import uniform

    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 12)), int(r.integers(0, 10))) for i in range(150)]
    df = spark.createDataFrame(rows, "tx_id long, user_key long, merchant_key long")
    got = {q.user_key: np.array(q.embedding) for q in graph.spectral_sketch(df, 4, 9).collect()}
    users, merchants = sorted({u for _, u, _ in rows}), sorted({m for _, _, m in rows})
    a = np.zeros((len(users), len(merchants)))
    for _, u, m in rows:
        a[users.index(u), merchants.index(m)] += 1
    a /= np.sqrt(np.outer(a.sum(1), a.sum(0)))
    draws = spark.createDataFrame([(m, k) for m in merchants for k in range(4)], "merchant_key long, k int").withColumn("u", uniform(9, "k", "merchant_key")).collect()
    signs = np.zeros((len(merchants), 4))
    for q in draws:
        signs[merchants.index(q.merchant_key), q.k] = -1 if q.u < 0.5 else 1
    s = a @ signs
    values, vectors = np.linalg.eigh(s.T @ s)
    want = s @ vectors[:, ::-1] / np.sqrt(values[::-1])
    have = np.array([got[u] for u in users])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-8) and np.allclose(have.T @ have, np.eye(4), atol=1e-8)


def test_block_bootstrap_equals_sql(spark, duck, sf_dir):
    from txloom.plans import registry
    from txloom.plans.q_metrics import _POISSON
    from txloom.plans.q_relational import _RUNS
    from txloom.sources.fixtures import U

    u = U.format("'26|' || draw || '|' || day")
    sql = f"""WITH {_RUNS}, g AS (SELECT tx.ts::DATE::VARCHAR AS day, sum(rb.score - ra.score) AS s, count(*) AS n FROM ra JOIN rb USING (tx_id) JOIN tx USING (tx_id) GROUP BY ALL),
    w AS (SELECT draw, s, n, {u} AS u FROM g, range(1, 201) d(draw)), m AS (SELECT draw, sum(({_POISSON}) * s) / sum(({_POISSON}) * n) AS m FROM w GROUP BY draw)
    SELECT avg(m), quantile_cont(m, 0.025), quantile_cont(m, 0.975) FROM m"""
    got = registry.QUERIES["met26_block_bootstrap"](spark, sf_dir).first()
    assert [got["mean"], got["lo"], got["hi"]] == pytest.approx(list(duck.sql(sql).fetchall()[0]), abs=2e-6)


def test_hierarchical_bootstrap_by_hand(spark, duck, sf_dir):
    """Each draw's average precision from rows repeated as often as their seed and day are drawn."""
    from txloom.plans import registry
    from txloom.sources.fixtures import SCORED, U

    rows = duck.sql(f"WITH {SCORED} SELECT user_key % 3 AS seed, strftime(ts, '%Y-%m') AS day, score, label FROM sc").df()
    cells = rows.groupby(["seed", "day", "score"]).label.agg(["size", "sum"]).reset_index()
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(5)])
    draw = lambda text: [int((x >= cdf).sum()) for (x,) in duck.sql(f"SELECT {U.format('t')} FROM (SELECT unnest({text}) AS t)").fetchall()]
    days, seeds = sorted(set(zip(cells.seed, cells.day, strict=True))), sorted(set(cells.seed))
    out = []
    for d in range(1, 51):
        of_day = dict(zip(days, draw([f"27|{d}|{s}|{x}" for s, x in days]), strict=True))
        of_seed = dict(zip(seeds, draw([f"28|{d}|{s}" for s in seeds]), strict=True))
        w = np.array([of_day[s, x] * of_seed[s] for s, x in zip(cells.seed, cells.day, strict=True)])
        by = cells.assign(n=cells["size"] * w, p=cells["sum"] * w).groupby("score")[["n", "p"]].sum().sort_index(ascending=False)
        tp, seen, total = by.p.cumsum(), by.n.cumsum(), by.p.sum()
        if total:
            out.append(float((by.p * tp / seen.where(seen > 0))[seen > 0].sum() / total))
    got = registry.QUERIES["met27_hierarchical_bootstrap"](spark, sf_dir).first()
    assert [got["mean"], got["lo"], got["hi"]] == pytest.approx([np.mean(out), *np.quantile(out, [0.025, 0.975])], abs=2e-6)


def test_pca_equals_svd(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {r.vec_id: r.pc for r in model.pca(e.filter("vec_id % 5 <> 0"), e, "embedding").collect()}
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    train = np.array([r.vec_id % 5 != 0 for r in rows])
    centre = x[train].mean(0)
    want = (x - centre) @ np.linalg.svd(x[train] - centre, full_matrices=False)[2][:2].T
    have = np.array([got[r.vec_id] for r in rows])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-4)


def test_hybrid_trees_learn_and_their_gain_is_whole(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(r.normal()), [float(v) for v in r.normal(size=3)]) for i in range(400)]
    rows = [(i, v, e, int(v + 0.2 * e[0] > 0.5)) for i, v, e in rows]
    df = spark.createDataFrame(rows, "tx_id long, v double, embedding array<double>, label int")
    scores, gain = model.hybrid(df.filter("tx_id % 2 = 0"), df.filter("tx_id % 2 = 1"), ["v"], "embedding")
    got, truth = {q.tx_id: q.score for q in scores.collect()}, {i: y for i, _, _, y in rows}
    assert len(got) == 200 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(s > 0.5) == truth[i] for i, s in got.items()]) > 0.93
    share = {q.family: q.share for q in gain.collect()}
    assert sum(share.values()) == pytest.approx(1) and share["tabular"] > 0.7
    again, _ = model.hybrid(df.filter("tx_id % 2 = 0"), df.filter("tx_id % 2 = 1"), ["v"], "embedding")
    assert {q.tx_id: q.score for q in again.collect()} == got


def test_files_on_any_file_system(spark, tmp_path):
    from txloom.functions import files
    from txloom.sources import sinks

    for store, home in ((files.SparkFiles(spark), f"file://{tmp_path}/a"), (files.LocalFiles(), f"{tmp_path}/b")):
        for text in (b"one", b"two"):
            files.write_whole(store, f"{home}/x/y.bin", text)
            assert store.read(f"{home}/x/y.bin") == text
        store.create(f"{home}/lock", b"")
        with pytest.raises(Exception, match="exist"):
            store.create(f"{home}/lock", b"")
        store.remove(f"{home}/lock")
        assert not store.exists(f"{home}/lock")
        run = sinks.Run(f"{home}/run", spark if "file" in home else None)
        with run, pytest.raises(Exception, match="exist"), run:
            pass
    assert not list(tmp_path.rglob("*.part"))
    arrays = np.load(__import__("io").BytesIO(sinks.array_bytes(a=np.arange(3), b=np.ones((2, 2)))))
    assert arrays["a"].tolist() == [0, 1, 2] and arrays["b"].shape == (2, 2)


def test_errors_of_the_file_system_are_tried_again():
    from txloom.functions import files

    left = [2]

    def act():
        if left[0]:
            left[0] -= 1
            raise PermissionError("held")

    files.retried(act, 5, 0.001)
    with pytest.raises(PermissionError):
        files.retried(lambda: (_ for _ in ()).throw(PermissionError("held")), 2, 0.001)


def test_typed_forward_equals_numpy(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(30, 3))
    users, shops = r.integers(0, 5, 30), r.integers(0, 4, 30)
    w = model.typed_weights(3, 4, ["u", "m"])
    features = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(30)], "tx_id long, x array<double>")
    roots = spark.createDataFrame([(i, int(users[i]), int(shops[i])) for i in range(30)], "tx_id long, u long, m long")
    near = {"u": [(int(e), i) for e in range(4) for i in np.flatnonzero(users == e)[:3].tolist()], "m": [(int(e), i) for e in range(4) for i in np.flatnonzero(shops == e)[:3].tolist()]}
    sides = {s: spark.createDataFrame(rows, "entity long, tx_id long") for s, rows in near.items()}
    got = {q.tx_id: q.logit for q in model.typed_forward(roots, sides, features, w).collect()}
    state = {s: {e: np.maximum(x[[i for k, i in rows if k == e]].mean(0) @ w[s], 0) for e in {k for k, _ in rows}} for s, rows in near.items()}
    for i in range(30):
        ends = (state["u"].get(users[i], np.zeros(4)) + state["m"].get(shops[i], np.zeros(4))) / 2
        assert got[i] == pytest.approx(float((np.maximum(x[i] @ w["own"] + ends @ w["near"], 0) @ w["head"])[0]), abs=1e-9)


@pytest.mark.parametrize("rows_in_batch", ["3", "10000"])
def test_groups_are_carried_over_batches(spark, rows_in_batch):
    from txloom.streaming import groups

    r = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else int(r.integers(0, 4)), int(r.integers(0, 50))) for i in range(120)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
    try:
        got = {q.tx_id: (q.place, q.gap) for q in groups.carried(spark.createDataFrame(rows, "tx_id long, user_key long, sec long"), "user_key").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = {}, {}
    for i, k, s in sorted(rows, key=lambda x: (x[2], x[0])):
        place, before_s = last.get(k, (0, None))
        want[i] = (place + 1, None if before_s is None else s - before_s)
        last[k] = (place + 1, s)
    assert got == want


@pytest.mark.parametrize("mode", ["static", "moving"])
def test_causal_neighbours_draw_pairs_without_a_join_of_them(spark, monkeypatch, mode):
    """Units smaller than an entity give the k best draws of all pairs, and no pair is joined, sorted or exchanged."""
    monkeypatch.setattr(sampling, "UNIT", 4)
    tx = spark.sql("SELECT id AS tx_id, CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 END AS entity, TIMESTAMP_NTZ '2020-01-01' + make_dt_interval(id % 9) AS ts FROM range(60)")
    roots = tx.select(F.col("tx_id").alias("root"), "entity", F.to_date("ts").alias("day"))
    got = sampling.causal_neighbours(roots, tx, 3, 5, mode)
    pairs = roots.join(tx.withColumnRenamed("entity", "e"), (F.col("entity") == F.col("e")) & (F.col("tx_id") != F.col("root")))
    pairs = pairs if mode == "static" else pairs.filter(F.to_date("ts") < F.col("day"))
    want = sampling.top_k(pairs, ["root"], sampling.gumbel(sampling.uniform(5, "root", "tx_id")), 3).select("root", "tx_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "SortMergeJoin" not in got._jdf.queryExecution().optimizedPlan().toString() and " Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_causal_scores_take_k_of_the_earlier_days(spark):
    """Against factorised_scores on the sample that the draws give; a hub over several batches, entities of one row, null entities and times."""
    w = model.sage_weights(2, 4)
    tx = spark.sql("SELECT id AS tx_id, CASE WHEN id % 29 = 3 THEN NULL WHEN id % 2 = 0 THEN 5 ELSE id % 13 + id DIV 80 * 100 END AS entity, CASE WHEN id % 31 <> 4 THEN TIMESTAMP_NTZ '2020-01-01' + make_dt_interval(id % 40 DIV 3, 3) END AS ts, array(cast(id % 11 AS float), cast(id % 5 AS float)) AS x FROM range(400)")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.tx_id: r.logit for r in model.causal_scores(tx, 8, 3, w).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows, near, sizes = tx.collect(), [], []
    for r in rows:
        past = sorted((q.ts.date(), q.tx_id) for q in rows if None not in (r.entity, r.ts, q.entity, q.ts) and q.entity == r.entity and q.ts.date() < r.ts.date())
        digests = b"".join(hashlib.sha256(f"3|{i}|{r.tx_id}".encode()).digest() for i in range(2))
        draws = [(int.from_bytes(digests[8 * i : 8 * i + 8]) >> 11) / 2**53 for i in range(8)]
        taken = list(range(len(past))) if len(past) <= 8 else []
        for i in range(8 if len(past) > 8 else 0):
            last = len(past) - 8 + i
            at = int(draws[i] * (last + 1))
            taken.append(last if at in taken else at)
        assert len(set(taken)) == min(8, len(past))
        sizes.append(len(past))
        near += [(r.tx_id, past[i][1]) for i in taken]
    assert max(sizes) > 100 and min(sizes) == 0
    want = model.factorised_scores(tx.select("tx_id", F.col("tx_id").alias("entity")), spark.createDataFrame(near, "entity long, tx_id long"), tx.select("tx_id", "x"), w)
    want = {r.tx_id: r.logit for r in want.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_two_layers_exchange_no_row_of_the_result(spark):
    """Against sets built from the same draws, where many transactions share both ends; the result isn't made distinct afterwards."""
    tx = [(i, i % 3, i % 2 if i < 20 else i % 5) for i in range(40)]
    adjacency = graph.adjacency(spark.createDataFrame([(*t, t[0] % 4 == 0) for t in tx], "tx_id long, user_key long, merchant_key long, label boolean"))
    got = sampling.two_layers(adjacency.filter("label"), adjacency, (6, 4), 11)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [root" not in plan and "Union" not in plan.split("Generate posexplode")[0]
    key = F.concat_ws(":", "side", "entity")
    sample = [{(r.k, r.tx_id) for r in sampling.top_k(adjacency.withColumn("k", key), ["k"], sampling.gumbel(sampling.uniform(11 + i, "k", "tx_id")), k).collect()} for i, k in enumerate((6, 4))]
    ends = {t: (f"user:{u}", f"merchant:{m}") for t, u, m in tx}
    first = {(t, 1, t, s) for t in ends if t % 4 == 0 for k, s in sample[0] if k in ends[t] and s != t}
    second = {(r, 2, s, x) for r, _, _, s in first for k, x in sample[1] if k in ends[s] and x != s}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(first | second)
