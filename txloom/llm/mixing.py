"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents are shuffled by a hash. A document's virtual finish time is the number of its source's
words up to and including it, divided by the source's target; its second copy finishes one pass of the source
later. All copies are then put in one global order of virtual time and cut at the total budget, so every source
gives about its target.

Targets: sources in code point order (null last) have WEIGHTS in turn and share SHARE of all words. A target
stops at REPEATS times its source's words, and what is over goes to the others by weight until none is above.

Scale: no task gets a whole source. A source's cumulative words are found in three levels: a window in each
(source, hash prefix), one over the sums of prefixes that begin alike, and one over these; the prefix's length follows the
number of rows, so that a source with most rows is in many tasks. The global
order is cut in bins of virtual time; words are even over virtual time by construction, so bins are even too. The bin in
which the budget ends is found by two levels of sums, and only that bin is ranked. The driver gets single rows. Everything runs on rows of a few numbers,
checkpointed after one scan of the texts.

Null texts and texts without words have size 0 and take nothing. Repeated rows are documents of their own; rows
that agree in doc_id and size are interchangeable. A null source is a source. An empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut, n_words, row_key

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: About so many rows in a window's partition.
ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, target, from rows of source and size.

    A source is full at the water level that its limit over its weight gives; with sources in that order, a
    source is full if the level that uses up the budget, were it and all after it open, is not below its own. From the
    first source that isn't full on, these levels fall, so the first and greatest is the water level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    some = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    some = some.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    some = some.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    some = some.withColumn("limit", (F.col("source_size") * repeats).cast("double")).withColumn("level", F.col("limit") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    some = some.withColumn("open_level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    some = some.withColumn("full", F.col("open_level") >= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("open_level"))).over(Window.partitionBy())
    return some.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level).alias("target"))


def shuffled(seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))


def timed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, place (the shuffle's hash), words (cumulative in the source), carried columns."""
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffled(seed).alias("place"), *carry))
    digits = max(1, ceil(log(max(rows.count(), 1) / ROWS + 1, 16))) + 1
    rows = rows.withColumn("slot", F.substring("place", 1, digits))
    sums = cut(rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))).withColumn("run", F.substring("slot", 1, digits // 2))
    before = lambda by, order, size: F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("source", "run").agg(F.sum("slot_size").alias("run_size"))
    runs = runs.select(F.col("source").alias("_r"), F.col("run").alias("_of"), before(["source"], "run", "run_size").alias("start"))
    sums = sums.withColumn("low", before(["source", "run"], "slot", "slot_size"))
    sums = sums.join(runs, sums["source"].eqNullSafe(runs["_r"]) & (sums["run"] == runs["_of"])).select(F.col("source").alias("_s"), F.col("slot").alias("_b"), (F.col("start") + F.col("low")).alias("base"))
    inside = Window.partitionBy("source", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["slot"] == sums["_b"])).withColumn("words", F.col("base") + F.col("inside"))
    aims = targets(rows.select("source", "size"), weights, share, repeats).withColumnRenamed("source", "_t")
    return rows.join(aims, rows["source"].eqNullSafe(aims["_t"])).select("doc_id", "source", "size", "source_size", "target", "place", "words", *carry)


def copy_times(repeats: int) -> Column:
    """Virtual finish times of a document's copies; none for a document without words."""
    each = F.array(*(((F.lit(k).cast("long") * F.col("source_size") + F.col("words")) / F.col("target")) for k in range(repeats)))
    return F.when((F.col("size") > 0) & (F.col("target") > 0), each).otherwise(F.array().cast("array<double>"))


def crossing(sums: DataFrame, budget: float, width: int) -> Row | None:
    """The bin in which the words, added up in order of bins, go over the budget, and the words before it; none: null.

    First runs of `width` bins are added up, then the bins of the run in which the budget is crossed, so a task has the square
    root of the bins or so.
    """

    def over(table: DataFrame, key: str, before: float) -> Row | None:
        upto = F.sum("words").over(Window.orderBy(key)) + F.lit(before)
        return table.withColumn("upto", upto).filter(F.col("upto") > F.lit(budget)).orderBy(key).select(F.col(key).alias("bin"), (F.col("upto") - F.col("words")).alias("before")).first()

    runs = sums.groupBy(F.floor(F.col("bin") / width).alias("run")).agg(F.sum("words").alias("words"))
    found = over(runs, "run", 0)
    return found and over(sums.filter(F.floor(F.col("bin") / width) == found["bin"]), "bin", found["before"])


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """timed() with times (virtual finish times of the copies), copies (how many of them the mix takes) and taken (their words)."""
    rows = cut(timed(docs, seed, weights, share, repeats, carry).withColumn("times", copy_times(repeats)))
    total, count = rows.select("size").agg(F.sum("size"), F.count("*")).first()
    budget = (total or 0) * share
    bins = max(16, (count or 0) * repeats // ROWS)
    copies = rows.select("doc_id", "size", "place", F.explode("times").alias("time")).withColumn("bin", F.floor(F.col("time") * bins))
    sums = cut(copies.groupBy("bin").agg(F.sum("size").alias("words")))
    last = crossing(sums, float(budget), max(1, bins // ROWS))
    if last is None:
        n = F.size("times")
    else:
        order = Window.orderBy("time", "place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        fits = copies.filter(F.col("bin") == last["bin"]).withColumn("upto", F.sum("size").over(order) + F.lit(last["before"])).filter(F.col("upto") <= F.lit(float(budget)))
        end = fits.agg(F.max(F.struct("time", "place", "doc_id", "size")).alias("end")).first()["end"]
        early = lambda t: F.floor(t * bins) < last["bin"]
        if end is None:
            n = F.size(F.filter("times", early))
        else:
            key = F.struct(F.lit(end["time"]).alias("time"), F.lit(end["place"]).alias("place"), F.lit(end["doc_id"]).cast("long").alias("doc_id"), F.lit(end["size"]).cast("long").alias("size"))
            own = lambda t: F.struct(t.alias("time"), F.col("place").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("size").alias("size"))
            n = F.size(F.filter("times", lambda t: early(t) | ((F.floor(t * bins) == last["bin"]) & (own(t) <= key))))
    return rows.withColumn("copies", n.cast("int")).withColumn("taken", F.col("size") * F.col("copies"))


def mixture(docs: DataFrame, **rule: object) -> DataFrame:
    """The columns of docs, a row for each copy that the mix takes.

    The rule is worked out on numbers and a hash of each row, and joined back by that hash, so texts are exchanged once. Rows
    that repeat one another in all columns are joined as one, with the copies of all of them.
    """
    columns = docs.columns
    keyed = docs.withColumn("_key", row_key(columns))
    own = mixed(keyed, carry=("_key",), **rule).filter("copies > 0").groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies"))
    rows = keyed.dropDuplicates(["_key"]).join(own, "_key")
    return rows.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_copy")).select(*columns)
