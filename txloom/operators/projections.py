"""Parsing, key building, predicates and audits of raw transaction records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<missing>"
# The codes that count as domestic, in alphabetical order.
DOMESTIC = "AK AL AR AZ CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split()


def key(c: Column | str) -> Column:
    """Trimmed text; blank and null become <missing>."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(MISSING))


def timestamp(year: str, month: str, day: str, time: str, lenient: bool = False) -> Column:
    """A timestamp without zone from its parts; H:MM or H:MM:SS; null on failure. lenient: a missing time is midnight."""
    t = F.coalesce(F.col(time), F.lit("00:00")) if lenient else F.col(time)
    text = F.concat(F.lpad(F.col(year).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col(month).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.col(day).cast("string"), 2, "0"), F.lit(" "), F.trim(t))
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}$"), F.concat(text, F.lit(":00"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}$"), text)
    padded = F.regexp_replace(whole, r" (\d):", " 0$1:")
    return padded.try_cast("timestamp_ntz")


def currency(c: Column | str) -> Column:
    """$1,234.50 and the like as a double; null on failure."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.trim(c), F.lit("$"), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def label(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(F.trim(c))
    return F.when(low == "yes", 1).when(low == "no", 0)


def client_key(user: str, card: str) -> Column:
    return F.concat_ws("::", key(user), key(card))


def location_key(*parts: str) -> Column:
    return F.concat_ws("|", *(key(p) for p in parts))


def state_bin(c: Column | str) -> Column:
    """US_Domestic, International or Missing_Online."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    return F.when(c.isNull() | F.lower(t).isin("", "nan", "none", "online"), "Missing_Online").when(F.upper(t).isin(DOMESTIC), "US_Domestic").otherwise("International")


def anonymous(value: Column | str, salt: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), value.cast("string")), 256), 1, 16)


def between(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """start <= ts < end."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def parsed(raw: DataFrame) -> DataFrame:
    """Raw text columns (D1) to typed columns (D2)."""
    return raw.select(
        "source_row", key("User").alias("user_key"), key("Card").alias("card_key"), key("Merchant Name").alias("merchant_key"), key("Merchant City").alias("city_key"),
        key("Merchant State").alias("state_key"), key("Zip").alias("zip_key"), key("Use Chip").alias("use_chip_key"), key("MCC").alias("mcc_key"), key("Errors?").alias("errors_key"),
        timestamp("Year", "Month", "Day", "Time").alias("ts"), currency("Amount").alias("amount"), label("Is Fraud?").alias("label"),
    )


def audit(df: DataFrame, entities: tuple[str, ...] = ("user_key", "merchant_key")) -> DataFrame:
    """total, invalid_ts, invalid_label and the invalid entities."""
    bad = {"invalid_ts": F.col("ts").isNull(), "invalid_label": F.col("label").isNull() | ~F.col("label").isin(0, 1)} | {f"invalid_{e}": F.coalesce(F.col(e).cast("string"), F.lit(MISSING)) == MISSING for e in entities}
    return df.agg(F.count("*").alias("total"), *(F.count(F.when(c, 1)).alias(n) for n, c in bad.items()))


def checked(df: DataFrame, entities: tuple[str, ...] = ("user_key", "merchant_key")) -> DataFrame:
    """df, or an error that names what the audit found."""
    found = {k: v for k, v in audit(df, entities).first().asDict().items() if k != "total" and v}
    if found:
        raise ValueError(f"invalid rows: {found}")
    return df


def two_classes(df: DataFrame, by: str = "split") -> DataFrame:
    """rows, positives, ok for each split: ok if both classes are there."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("positives")).withColumn("ok", ((F.col("positives") > 0) & (F.col("positives") < F.col("rows"))).cast("int"))


def role_overlap(df: DataFrame, role: str, key_: str = "tx_id") -> DataFrame:
    """Ids that several roles share (there should be none), and each role's bounds in time."""
    shared = df.groupBy(key_).agg(F.countDistinct(role).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("shared"))
    return df.groupBy(role).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("rows")).crossJoin(F.broadcast(shared))


def order_violations(df: DataFrame, order: str = "tx_id") -> DataFrame:
    """How many rows are earlier than the row before them: within days by lag, between days by their bounds."""
    from pyspark.sql import Window

    lag = F.lag("ts").over(Window.partitionBy(F.to_date("ts")).orderBy(order))
    inside = df.withColumn("_back", (lag > F.col("ts")).cast("int")).agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("inside"))
    days = df.groupBy(F.to_date("ts").alias("_d")).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    across = days.withColumn("_back", (F.lag("hi").over(Window.orderBy("_d")) > F.col("lo")).cast("int")).agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("across"))
    return inside.crossJoin(F.broadcast(across)).select((F.col("inside") + F.col("across")).alias("violations"))


def misaligned(a: DataFrame, b: DataFrame, key_: str = "tx_id") -> DataFrame:
    """only_a, only_b, label_differs, aligned over two prediction tables."""
    left, right = a.select(key_, F.col("label").alias("la"), F.lit(1).alias("ina")), b.select(key_, F.col("label").alias("lb"), F.lit(1).alias("inb"))
    j = left.join(right, key_, "full_outer")
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    counts = {"only_a": F.col("inb").isNull(), "only_b": F.col("ina").isNull(), "label_differs": both & ~F.col("la").eqNullSafe(F.col("lb")), "aligned": both & F.col("la").eqNullSafe(F.col("lb"))}
    return j.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in counts.items()))


def completeness(found: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Every expected cell (the product of the small axis tables) and every found one: times found, and state missing, ok, duplicate or extra."""
    expected = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes).withColumn("_e", F.lit(1))
    keys = [c for c in expected.columns if c != "_e"]
    got = found.groupBy(*keys).agg(F.count("*").alias("found"))
    j = expected.join(got, keys, "full_outer").withColumn("found", F.coalesce("found", F.lit(0)))
    return j.withColumn("state", F.when(F.col("_e").isNull(), "extra").when(F.col("found") == 0, "missing").when(F.col("found") > 1, "duplicate").otherwise("ok")).drop("_e")
