"""Queries over scans and sinks (SRC, SNK): what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.checkpoints import shared_dir
from ..operators import splits as S
from ..sources import raw as R
from ..sources import sinks as K
from ..sources.fixtures import SCORED, TX, scored, transactions
from . import q_projections as QP
from .registry import query


def place(spark, name):  # noqa: ANN001, ANN201
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(spark, d):  # noqa: ANN001, ANN202
    path = place(spark, "csv")
    QP.raw(spark, d).orderBy("source_row").drop("source_row").coalesce(1).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("src1_csv_scan", f'WITH {QP.RAW} SELECT source_row, "User", "Merchant Name", "MCC" FROM raw')
def _(spark, d):
    return R.csv(spark, _csv(spark, d)).select("source_row", "User", "Merchant Name", "MCC")


@query("src1_csv_limit", f'WITH {QP.RAW} SELECT source_row, "User" FROM raw WHERE source_row < 100')
def _(spark, d):
    return R.csv(spark, _csv(spark, d), limit=100).select("source_row", "User")


@query("src2_pruned_csv", f'WITH {QP.RAW} SELECT source_row, "Merchant Name" FROM raw')
def _(spark, d):
    return R.csv(spark, _csv(spark, d), columns=["Merchant Name"])


@query("src3_year_and_cap", f"WITH {TX} SELECT tx_id, user_key FROM tx WHERE year(ts) >= 1997 ORDER BY tx_id LIMIT 1000")
def _(spark, d):
    return R.from_year(transactions(spark, d), 1997, 1000, "tx_id").select("tx_id", "user_key")


@query("src4_normalised_chunks", f"WITH {QP.PARSED} SELECT source_row, user_key, card_key, ts, round(amount, 6) AS amount, label FROM parsed")
def _(spark, d):
    from ..operators.projections import parsed

    return parsed(QP.raw(spark, d)).select("source_row", "user_key", "card_key", "ts", "amount", "label")


@query("src5_fold_scan", f"WITH {TX} SELECT tx_id, ts FROM tx WHERE ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1997-09-01'")
def _(spark, d):
    return R.fold(transactions(spark, d), "1997-03-01", "1997-09-01").select("tx_id", "ts")


@query("src6_window_cache", f"WITH {TX} SELECT count(*) AS rows, sum(label)::BIGINT AS fraud FROM tx WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1999-01-01'")
def _(spark, d):
    home, identity = place(spark, "cache"), {"table": "tx", "from": "1997-01-01", "to": "1999-01-01"}
    build = lambda: R.fold(transactions(spark, d), "1997-01-01", "1999-01-01")
    K.content_store(spark, home, identity, build)
    again = K.content_store(spark, home, identity, build)  # found, not built
    return again.agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("fraud"))


@query("src7_daily_scan", f"WITH {TX} SELECT ts::DATE::VARCHAR AS day, count(*) AS rows, sum(label)::BIGINT AS fraud FROM tx WHERE year(ts) >= 1998 GROUP BY ALL")
def _(spark, d):
    return R.daily_counts(transactions(spark, d), 1998)


def _predictions(spark, d):  # noqa: ANN001, ANN202
    path = place(spark, "predictions")
    K.predictions(S.rank_split(scored(transactions(spark, d))).select("tx_id", "split", "label", F.col("score").alias("probability")), path)
    return path


_PRED = f"{SCORED}, n AS (SELECT count(*) AS n FROM tx) SELECT tx_id, label, score AS probability FROM sc, n WHERE tx_id >= floor(n * (0.7::DOUBLE + 0.15::DOUBLE))"


@query("src8_prediction_loader", f"WITH {_PRED}")
def _(spark, d):
    return R.predictions(spark, _predictions(spark, d), "test").select("tx_id", "label", "probability")


@query("src9_column_store", f"WITH {_PRED}")
def _(spark, d):
    return spark.read.parquet(_predictions(spark, d)).filter("split = 'test'").select("tx_id", "label", "probability")


def _runs(spark, d):  # noqa: ANN001, ANN202
    home = place(spark, "runs")
    t = transactions(spark, d).groupBy("channel").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    doc = F.to_json(F.struct(F.struct(F.col("n").alias("rows"), F.array("p", "n").alias("parts"), F.lit(True).alias("ok")).alias("metrics"), F.lit("x").alias("name")))
    t.select("channel", doc.alias("value")).write.partitionBy("channel").text(home)
    return home


@query("src10_artifact_discovery", f"WITH {TX} SELECT channel, count(*) AS files FROM (SELECT DISTINCT channel FROM tx) GROUP BY ALL")
def _(spark, d):
    found = R.artifacts(spark, _runs(spark, d), "*.txt")
    return found.groupBy(F.regexp_extract("path", r"channel=(\w+)", 1).alias("channel")).agg(F.count("*").alias("files"))


@query("src11_flat_json", f"WITH {TX}, g AS (SELECT channel, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM tx GROUP BY ALL) SELECT channel, 'metrics.rows' AS metric, n AS value FROM g UNION ALL SELECT channel, 'metrics.parts[0]', p FROM g UNION ALL SELECT channel, 'metrics.parts[1]', n FROM g")
def _(spark, d):
    found = R.artifacts(spark, _runs(spark, d), "*.txt").withColumn("channel", F.regexp_extract("path", r"channel=(\w+)", 1))
    return R.flat_numbers(found, "text", ["channel"])


@query("snk1_sorted_parquet", f"WITH {TX} SELECT tx_id, ts, amount FROM tx")
def _(spark, d):
    path = place(spark, "sorted")
    K.sorted_parquet(transactions(spark, d).select("tx_id", "ts", "amount"), path, ["ts", "tx_id"], 8)
    return spark.read.parquet(path)


@query("snk2_entity_buckets", f"WITH {TX} SELECT user_key, count(*) AS rows FROM tx GROUP BY ALL")
def _(spark, d):
    name = f"features_{uuid.uuid4().hex}"
    K.by_entity(transactions(spark, d).select("user_key", "tx_id", "amount"), name, "user_key", 8, ["tx_id"])
    return spark.table(name).groupBy("user_key").agg(F.count("*").alias("rows"))


@query("snk3_csv_predictions", f"WITH {SCORED} SELECT tx_id, label FROM sc")
def _(spark, d):
    path = place(spark, "csv-predictions")
    K.predictions(scored(transactions(spark, d)).select("tx_id", "label", "score"), path, "csv")
    return spark.read.schema("tx_id long, label int, score double").option("header", True).csv(path).select("tx_id", "label")


@query("snk4_whole_json", f"WITH {TX} SELECT channel, count(*) AS rows FROM tx GROUP BY ALL")
def _(spark, d):
    path = place(spark, "json")
    for extra in ([{"channel": "old", "rows": 0}], []):  # the second write replaces the first
        counts = transactions(spark, d).groupBy("channel").agg(F.count("*").alias("rows")).collect()
        K.write_json(f"{path}/metrics.json", [*extra, *(r.asDict() for r in counts)], spark=spark)
    return spark.read.schema("channel string, rows long").option("multiLine", True).json(f"{path}/metrics.json")


@query("snk5_content_store", f"WITH {TX} SELECT user_key, count(*) AS rows FROM tx GROUP BY ALL")
def _(spark, d):
    return K.content_store(spark, place(spark, "store"), {"what": "user rows"}, lambda: transactions(spark, d).groupBy("user_key").agg(F.count("*").alias("rows")))


@query("snk6_run_states", "SELECT * FROM (VALUES ('new', 0, 0), ('failed', 1, 0), ('running', 2, 1), ('complete', 2, 0)) t(status, attempts, locked)")
def _(spark, d):
    run = K.Run(place(spark, "run"), spark)
    seen = []

    def note():  # noqa: ANN202
        seen.append((run.status()["status"], run.status()["attempts"], int(run.files.exists(f"{run.path}/lock"))))

    note()
    try:
        with run:
            raise RuntimeError("broken")
    except RuntimeError:
        note()
    with run:
        note()
    note()
    return spark.createDataFrame(seen, "status string, attempts int, locked int")


@query("snk7_row_digest", "SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY ALL")
def _(spark, d):
    from ..sources.fixtures import table

    return table(spark, d, "orders").groupBy("o_custkey").agg(K.column_digest(F.col("o_orderkey"), F.col("o_orderkey")).alias("digest"))
