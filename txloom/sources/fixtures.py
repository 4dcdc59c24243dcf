"""The transaction shape over the star schema and the event table, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import shared_dir
from ..functions.files import SparkFiles

TIE = ["t1", "t2", "t3", "t4", "t5"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str | Column = "ts") -> Column:
    """Whole seconds since 1970, whatever the session's time zone."""
    name = ts if isinstance(ts, str) else None
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")


def chronological_id(df: DataFrame, tie: list[str], name: str = "tx_id") -> DataFrame:
    """A gapless id in order of (ts, tie): ranks inside a day plus the number of rows of earlier days.

    No task holds more than a day, and the window over days has a row for each day.
    """
    days = df.groupBy(F.to_date("ts").alias("_day")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("ts", *tie))
    ranked = df.withColumn("_day", F.to_date("ts")).withColumn("_rank", inside)
    return ranked.join(days, "_day").withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_day", "_rank", "_before")


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with many timestamp ties: customers buy at suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    returned = F.col("l_returnflag") == "R"
    return joined.select(
        F.col("o_custkey").alias("user_key"),
        F.col("o_orderpriority").alias("card_key"),
        F.col("l_suppkey").alias("merchant_key"),
        F.col("o_orderstatus").alias("channel"),
        F.col("p_type").alias("mcc"),
        F.col("n_name").alias("city_key"),
        F.col("r_name").alias("state_key"),
        F.col("s_nationkey").alias("zip_key"),
        F.when(returned, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amount"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), "ERR").alias("errors_key"),
        F.col("l_shipdate").alias("ts"),
        F.when(returned & (F.col("l_discount") >= 0.08), 1).otherwise(0).alias("label"),
        F.col("l_orderkey").alias("t1"),
        F.col("l_linenumber").alias("t2"),
        F.col("l_partkey").alias("t3"),
        F.col("l_suppkey").alias("t4"),
        F.col("l_extendedprice").alias("t5"),
    )


def identity(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files below paths, on any file system that Spark reads."""
    seen = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        each = files.listFiles(at, True)
        while each.hasNext():
            f = each.next()
            seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_lineitem with tx_id and whole seconds, prepared once for the files of its tables and then read from the shared folder.

    The joins and the global order are the same for all operators, so they are written at the first use; a change of any
    file gives another folder. The writer's commit makes a folder that was left half done not count.
    """
    names = ("lineitem", "orders", "part", "supplier", "nation", "region")
    path = f"{shared_dir(spark)}/transactions-{identity(spark, [f'{sf_dir}/{n}.parquet' for n in names])}"
    if not SparkFiles(spark).exists(f"{path}/_SUCCESS"):
        prepared(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronological_id(tx_lineitem(spark, sf_dir), TIE).drop(*TIE).withColumn("sec", seconds())


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions: high-resolution timestamps."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("tx_id"), F.col("user_id").alias("user_key"), F.get_json_object("props", "$.k").cast("long").alias("merchant_key"),
        F.col("event_type").alias("channel"), F.col("value").alias("amount"), "ts", (F.col("event_type") == "error").cast("int").alias("label"),
    ).withColumn("sec", seconds())


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from SHA-256 of the parts joined by |, the same in any engine."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) if isinstance(p, int) else F.col(p) for p in parts]
    digest = F.sha2(F.concat_ws("|", *(c.cast("string") for c in columns)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def scored(tx: DataFrame) -> DataFrame:
    """tx with a deterministic surrogate score in hundredths, so that scores tie."""
    raw = uniform(1, "tx_id") * 0.6 + F.col("label") * 0.4 * uniform(2, "tx_id")
    return tx.withColumn("score", F.floor(raw * 100) / 100.0)


#: The same in DuckDB, as common table expressions.
U = "(('0x' || substr(sha256({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
TX = """tx AS (SELECT * EXCLUDE (t1, t2, t3, t4, t5), row_number() OVER (ORDER BY ts, t1, t2, t3, t4, t5) - 1 AS tx_id, epoch_us(ts) // 1000000 AS sec FROM (
 SELECT o_custkey AS user_key, o_orderpriority AS card_key, l_suppkey AS merchant_key, o_orderstatus AS channel, p_type AS mcc, n_name AS city_key,
  r_name AS state_key, s_nationkey AS zip_key, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount,
  CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN 'ERR' END AS errors_key, l_shipdate AS ts,
  CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 1 ELSE 0 END AS label,
  l_orderkey AS t1, l_linenumber AS t2, l_partkey AS t3, l_suppkey AS t4, l_extendedprice AS t5
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""
EV = """ev AS (SELECT event_id AS tx_id, user_id AS user_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS merchant_key, event_type AS channel,
 value AS amount, ts, (event_type = 'error')::INT AS label, epoch_us(ts) // 1000000 AS sec FROM events)"""
SCORED = f"""{TX}, sc AS (SELECT *, floor(({U.format("'1|' || tx_id")} * 0.6::DOUBLE + label * 0.4::DOUBLE * {U.format("'2|' || tx_id")}) * 100) / 100.0::DOUBLE AS score FROM tx)"""
