"""Queries over parsing, keys, predicates and audits (PRJ, PRD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as P
from ..operators import splits as S
from ..sources.fixtures import TX, table, transactions
from .registry import query


def raw(spark, d):  # noqa: ANN001, ANN201
    """Raw text records (D1) made of transactions, with blanks, nulls and malformed fields."""
    t, i = transactions(spark, d), F.col("tx_id")
    time = F.when(i % 97 == 0, "bad").when(i % 89 == 0, None).when(i % 5 == 0, F.concat((i % 24).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":07"))).otherwise(F.concat((i % 24).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0")))
    return t.select(
        i.alias("source_row"), F.col("user_key").cast("string").alias("User"), F.when(i % 7 == 0, "  ").when(i % 11 == 0, None).otherwise(F.concat(F.lit(" "), "card_key")).alias("Card"),
        F.year("ts").cast("string").alias("Year"), F.month("ts").cast("string").alias("Month"), F.dayofmonth("ts").cast("string").alias("Day"), time.alias("Time"),
        F.when(i % 13 == 0, "n/a").otherwise(F.concat(F.lit(" $"), F.format_number("amount", 2))).alias("Amount"), F.col("channel").alias("Use Chip"),
        F.concat(F.when(i % 3 == 0, "-").otherwise(""), F.lit("92233720368547"), F.lpad(F.col("merchant_key").cast("string"), 5, "0")).alias("Merchant Name"), F.col("city_key").alias("Merchant City"),
        F.when(i % 6 == 0, "CA").when(i % 6 == 1, " tx ").when(i % 6 == 2, "Italy").when(i % 6 == 3, "nan").when(i % 6 == 4, "").alias("Merchant State"),
        F.col("zip_key").cast("string").alias("Zip"), F.col("mcc").alias("MCC"), F.col("errors_key").alias("Errors?"), F.when(i % 101 == 0, "maybe").when(F.col("label") == 1, "Yes").otherwise("No ").alias("Is Fraud?"),
    )


RAW = f"""{TX}, raw AS (SELECT tx_id AS source_row, user_key::VARCHAR AS "User", CASE WHEN tx_id % 7 = 0 THEN '  ' WHEN tx_id % 11 = 0 THEN NULL ELSE ' ' || card_key END AS "Card",
 year(ts)::VARCHAR AS "Year", month(ts)::VARCHAR AS "Month", day(ts)::VARCHAR AS "Day",
 CASE WHEN tx_id % 97 = 0 THEN 'bad' WHEN tx_id % 89 = 0 THEN NULL WHEN tx_id % 5 = 0 THEN (tx_id % 24)::VARCHAR || ':' || lpad((tx_id % 60)::VARCHAR, 2, '0') || ':07' ELSE (tx_id % 24)::VARCHAR || ':' || lpad((tx_id % 60)::VARCHAR, 2, '0') END AS "Time",
 CASE WHEN tx_id % 13 = 0 THEN 'n/a' ELSE ' $' || format('{{:,.2f}}', amount) END AS "Amount", channel AS "Use Chip",
 CASE WHEN tx_id % 3 = 0 THEN '-' ELSE '' END || '92233720368547' || lpad(merchant_key::VARCHAR, 5, '0') AS "Merchant Name", city_key AS "Merchant City",
 CASE tx_id % 6 WHEN 0 THEN 'CA' WHEN 1 THEN ' tx ' WHEN 2 THEN 'Italy' WHEN 3 THEN 'nan' WHEN 4 THEN '' END AS "Merchant State",
 zip_key::VARCHAR AS "Zip", mcc AS "MCC", errors_key AS "Errors?", CASE WHEN tx_id % 101 = 0 THEN 'maybe' WHEN label = 1 THEN 'Yes' ELSE 'No ' END AS "Is Fraud?" FROM tx)"""
KEY = "coalesce(nullif(trim({0}), ''), '<missing>')".format
TS = """coalesce(try_strptime(lpad("Year", 4, '0') || '-' || lpad("Month", 2, '0') || '-' || lpad("Day", 2, '0') || ' ' || trim("Time"), '%Y-%m-%d %H:%M'), try_strptime(lpad("Year", 4, '0') || '-' || lpad("Month", 2, '0') || '-' || lpad("Day", 2, '0') || ' ' || trim("Time"), '%Y-%m-%d %H:%M:%S'))"""
AMOUNT = """TRY_CAST(replace(replace(trim("Amount"), '$', ''), ',', '') AS DOUBLE)"""
LABEL = """CASE lower(trim("Is Fraud?")) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END"""
PARSED = f"""{RAW}, parsed AS (SELECT source_row, {KEY('"User"')} AS user_key, {KEY('"Card"')} AS card_key, {KEY('"Merchant Name"')} AS merchant_key, {TS} AS ts, {AMOUNT} AS amount, {LABEL} AS label FROM raw)"""


@query("prj1_missing_key", f"WITH {RAW} SELECT source_row, {KEY('"Card"')} AS card_key, {KEY('"Merchant State"')} AS state_key FROM raw")
def _(spark, d):
    return raw(spark, d).select("source_row", P.key("Card").alias("card_key"), P.key("Merchant State").alias("state_key"))


@query("prj2_timestamp_assembly", f"WITH {RAW} SELECT source_row, {TS} AS ts FROM raw")
def _(spark, d):
    return raw(spark, d).select("source_row", P.timestamp("Year", "Month", "Day", "Time").alias("ts"))


@query("prj3_currency", f"WITH {RAW} SELECT source_row, round({AMOUNT}, 6) AS amount FROM raw")
def _(spark, d):
    return raw(spark, d).select("source_row", P.currency("Amount").alias("amount"))


@query("prj4_label", f"WITH {RAW} SELECT source_row, {LABEL} AS label FROM raw")
def _(spark, d):
    return raw(spark, d).select("source_row", P.label("Is Fraud?").alias("label"))


@query("prj5_client_key", f"WITH {RAW} SELECT source_row, {KEY('"User"')} || '::' || {KEY('"Card"')} AS client FROM raw")
def _(spark, d):
    return raw(spark, d).select("source_row", P.client_key("User", "Card").alias("client"))


@query("prj6_location_key", f"WITH {RAW} SELECT source_row, {KEY('"Merchant City"')} || '|' || {KEY('"Merchant State"')} || '|' || {KEY('"Zip"')} AS location FROM raw")
def _(spark, d):
    return raw(spark, d).select("source_row", P.location_key("Merchant City", "Merchant State", "Zip").alias("location"))


@query("prj7_state_bin", f"""WITH {RAW} SELECT source_row, CASE WHEN "Merchant State" IS NULL OR lower(trim("Merchant State")) IN ('', 'nan', 'none', 'online') THEN 'Missing_Online' WHEN upper(trim("Merchant State")) IN ({", ".join(f"'{s}'" for s in P.DOMESTIC)}) THEN 'US_Domestic' ELSE 'International' END AS area FROM raw""")
def _(spark, d):
    return raw(spark, d).select("source_row", P.state_bin("Merchant State").alias("area"))


@query("prj8_anonymous", "SELECT c_custkey, substr(sha256('salt|' || c_custkey), 1, 16) AS hash FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.anonymous("c_custkey", "salt").alias("hash"))


@query("prd1_half_open", f"WITH {TX} SELECT tx_id, ts FROM tx WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'")
def _(spark, d):
    return P.between(transactions(spark, d), "1996-01-01", "1997-01-01").select("tx_id", "ts")


@query("prd2_load_audit", f"WITH {PARSED} SELECT count(*) AS total, count(*) FILTER (ts IS NULL) AS invalid_ts, count(*) FILTER (label IS NULL) AS invalid_label, count(*) FILTER (user_key = '<missing>') AS invalid_user_key, count(*) FILTER (merchant_key = '<missing>') AS invalid_merchant_key FROM parsed")
def _(spark, d):
    return P.audit(P.parsed(raw(spark, d)))


_SPLIT = f"{TX}, n AS (SELECT count(*) AS n FROM tx), t AS (SELECT max(CASE WHEN tx_id = floor(n * 0.7::DOUBLE) - 1 THEN ts END) AS t1, max(CASE WHEN tx_id = floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) - 1 THEN ts END) AS t2 FROM tx, n), s AS (SELECT tx.*, CASE WHEN ts <= t1 THEN 'train' WHEN ts <= t2 THEN 'val' ELSE 'test' END AS split FROM tx, t)"


@query("prd3_two_classes", f"WITH {_SPLIT} SELECT split, count(*) AS rows, sum(label)::BIGINT AS positives, (sum(label) > 0 AND sum(label) < count(*))::INT AS ok FROM s GROUP BY split")
def _(spark, d):
    return P.two_classes(S.tie_safe_split(transactions(spark, d)))


@query("prd4_role_disjointness", f"WITH {_SPLIT} SELECT split, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows, (SELECT count(*) FROM (SELECT tx_id FROM s GROUP BY tx_id HAVING count(DISTINCT split) > 1)) AS shared FROM s GROUP BY split")
def _(spark, d):
    return P.role_overlap(S.tie_safe_split(transactions(spark, d)), "split")


@query("prd5_order_violations", f"WITH {TX} SELECT count(*) FILTER (before > ts) AS violations FROM (SELECT ts, lag(ts) OVER (ORDER BY tx_id) AS before FROM tx)")
def _(spark, d):
    return P.order_violations(transactions(spark, d))


@query("prd6_misaligned", f"WITH {TX}, a AS (SELECT tx_id, label FROM tx WHERE tx_id % 10 <> 3), b AS (SELECT tx_id, CASE WHEN tx_id % 50 = 1 THEN 1 - label ELSE label END AS label FROM tx WHERE tx_id % 10 <> 4) SELECT count(*) FILTER (b.tx_id IS NULL) AS only_a, count(*) FILTER (a.tx_id IS NULL) AS only_b, count(*) FILTER (a.label <> b.label) AS label_differs, count(*) FILTER (a.label = b.label) AS aligned FROM a FULL JOIN b USING (tx_id)")
def _(spark, d):
    t = transactions(spark, d).select("tx_id", "label")
    flipped = F.when(F.col("tx_id") % 50 == 1, 1 - F.col("label")).otherwise(F.col("label"))
    return P.misaligned(t.filter("tx_id % 10 <> 3"), t.filter("tx_id % 10 <> 4").withColumn("label", flipped))


@query("prd7_completeness", "WITH e AS (SELECT n_name, r_name FROM nation, region), f AS (SELECT n_name, CASE WHEN n_nationkey = 3 THEN 'ATLANTIS' ELSE r_name END AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 2), g AS (SELECT n_name, r_name, count(*) AS found FROM f GROUP BY ALL) SELECT coalesce(e.n_name, g.n_name) AS n_name, coalesce(e.r_name, g.r_name) AS r_name, coalesce(found, 0)::BIGINT AS found, CASE WHEN e.n_name IS NULL THEN 'extra' WHEN found IS NULL THEN 'missing' WHEN found > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM e FULL JOIN g ON e.n_name = g.n_name AND e.r_name = g.r_name")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    found = j.select("n_name", F.when(F.col("n_nationkey") == 3, "ATLANTIS").otherwise(F.col("r_name")).alias("r_name")).union(j.filter("n_nationkey < 2").select("n_name", "r_name"))
    return P.completeness(found, [n.select("n_name"), r.select("r_name")])
