"""Ranking metrics and paired statistics over scored rows (score, label). Undefined values are null, never 0.

Curves work on distinct scores: rows are aggregated by score first, so a window sees one row for each score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import counted, global_rank, of_key


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def confusion(df: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn at score >= threshold."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    cells = {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}
    return df.groupBy(*(by or [])).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in cells.items()))


def rates(counts: DataFrame) -> DataFrame:
    """The usual rates of tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p, rec, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return counts.withColumns({
        "precision": p, "recall": rec, "f1": f1, "f1_macro": (f1 + f0) / 2, "specificity": spec, "fpr": ratio(fp, fp + tn), "g_mean": F.sqrt(rec * spec),
        "accuracy": ratio(tp + tn, n), "alert_rate": ratio(tp + fp, n), "prevalence": ratio(tp + fn, n), "alerts_per_fraud": ratio(tp + fp, tp),
    })


def running(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, score, n, p, and cumulative tp and seen from the highest score down."""
    by = by or []
    scores = df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("p"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("n").over(w)})


def pr_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, score, precision, recall for each distinct score."""
    all_p = F.sum("p").over(Window.partitionBy(*(by or [])))
    return running(df, by).select(*(by or []), "score", "tp", "seen", (F.col("tp") / F.col("seen")).alias("precision"), ratio(F.col("tp"), all_p).alias("recall"))


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, ap: the sum over scores of gained recall times precision; null without positives."""
    return running(df, by).groupBy(*(by or [])).agg(ratio(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")).alias("ap"))


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, auc: chance that a positive outranks a negative, ties half; null if a class is absent."""
    negatives = F.col("n") - F.col("p")
    above = F.col("tp") - F.col("p")
    pairs = F.sum(negatives * (above + F.col("p") / 2))
    return running(df, by).groupBy(*(by or [])).agg(ratio(pairs, F.sum("p") * F.sum(negatives).cast("double")).alias("auc"))


def ranked(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rank 1.. by score down (null scores last), ties by tx_id; and n of the group. A group may hold most of the rows."""
    down = F.struct(F.col("score").isNull().alias("a"), (-F.col("score")).alias("b"), of_key("tx_id").alias("c"))
    return counted(global_rank(df, down, [F.col("score").desc(), "tx_id"], "rank", by), by or [], "n")


def mean_average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean over groups with positives of the precision at each positive's rank."""
    hits = global_rank(ranked(df, by).filter("label = 1"), of_key("rank"), ["rank"], "tp", by)
    return hits.groupBy(*by).agg(F.avg(F.col("tp") / F.col("rank")).alias("ap")).agg(F.avg("ap").alias("map"), F.count("*").alias("groups"))


def ndcg(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, ndcg at k with gains 2**label - 1; null without positives.

    The ideal order is that of the labels, so its first k gains follow from the number of rows with each label.
    """
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col("rank") + 1.0)
    got = ranked(df, by).filter(F.col("rank") <= k).groupBy(*by).agg(F.sum(gain).alias("dcg"))
    labels = df.groupBy(*by, "label").agg(F.count("*").alias("c"))
    above = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("label").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = labels.withColumn("o", above).filter(F.col("o") < k).withColumn("rank", F.explode(F.sequence(F.col("o") + 1, F.least(F.col("o") + F.col("c"), F.lit(k)))))
    best = places.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.sum(gain).alias("best"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return got.join(best, same).select(*by, ratio(F.col("dcg"), F.col("best")).alias("ndcg"))


def budget_k(n: Column, share: float, rule: str) -> Column:
    """Rows in the top share by one of the rounding rules: half_even (null if 0), at_least_one, ceil, floor (at least 1)."""
    x = n * F.lit(share)
    rounded = F.bround(x).cast("long")
    return {"half_even": F.when(rounded > 0, rounded), "at_least_one": F.greatest(rounded, F.lit(1)), "ceil": F.ceil(x), "floor": F.greatest(F.floor(x), F.lit(1))}[rule]


def at_budgets(df: DataFrame, budgets: list[int], by: list[str] | None = None) -> DataFrame:
    """by, k, tp, precision, recall among the first k."""
    by = by or []
    each = ranked(df, by).withColumn("k", F.explode(F.array(*map(F.lit, budgets))))
    out = each.groupBy(*by, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("label")).otherwise(0)).cast("long").alias("tp"), F.sum("label").cast("long").alias("p"), F.max("n").alias("n"))
    return out.select(*by, "k", "tp", ratio(F.col("tp"), F.least("k", "n")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def top_share(df: DataFrame, share: float, rule: str, by: list[str] | None = None) -> DataFrame:
    """by, k, tp, precision, lift (precision over prevalence), recall in the top share."""
    by = by or []
    rows = ranked(df, by).withColumn("k", budget_k(F.col("n"), share, rule))
    out = rows.groupBy(*by).agg(F.max("k").alias("k"), F.sum(F.when(F.col("rank") <= F.col("k"), F.col("label")).otherwise(0)).cast("long").alias("tp"), F.sum("label").cast("long").alias("p"), F.count("*").alias("n"))
    precision = ratio(F.col("tp"), F.col("k"))
    return out.select(*by, "k", "tp", precision.alias("precision"), ratio(precision, F.col("p") / F.col("n")).alias("lift"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def best_f(df: DataFrame, beta: float = 1.0, min_precision: float | None = None, largest: bool = True, by: list[str] | None = None) -> DataFrame:
    """by, threshold, f: the score with the best F-beta; ties go to the largest or the smallest threshold.

    With min_precision only scores that reach it count, or all where none does.
    """
    by = by or []
    curve = pr_curve(df, by)
    b = beta * beta
    f = ratio((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall"))
    curve = curve.withColumn("f", F.coalesce(f, F.lit(0.0)))
    good = F.lit(1) if min_precision is None else (F.col("precision") >= min_precision).cast("int")
    best = curve.groupBy(*by).agg(F.max(F.struct(good.alias("good"), "f", (F.col("score") if largest else -F.col("score")).alias("s"))).alias("x"))
    return best.select(*by, (F.col("x.s") if largest else -F.col("x.s")).alias("threshold"), F.col("x.f").alias("f"))


def grid(df: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """by, threshold, tp, fp, fn, tn for each threshold of a list, from distinct scores."""
    by = by or []
    scores = df.groupBy(*by, "score").agg(F.sum("label").cast("long").alias("p"), F.count("*").alias("n"))
    each = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, neg = F.col("score") >= F.col("threshold"), F.col("n") - F.col("p")
    cells = {"tp": (hit, F.col("p")), "fp": (hit, neg), "fn": (~hit, F.col("p")), "tn": (~hit, neg)}
    return each.groupBy(*by, "threshold").agg(*(F.sum(F.when(c, x).otherwise(0)).alias(k) for k, (c, x) in cells.items()))


def fpr_budget(df: DataFrame, budget: float) -> DataFrame:
    """cutoff: the largest score of a normal row that must not be flagged when at most budget of the normals may be; flag scores above it."""
    normals = df.filter("label = 0").groupBy("score").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = normals.withColumn("seen", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return seen.filter(F.col("seen") > F.floor(F.col("all") * budget)).agg(F.max("score").alias("cutoff"))


def paired_deltas(df: DataFrame, key: str, method: str, value: str) -> DataFrame:
    """a, b, n, mean, sd, median, wins, ties, losses of b - a over the keys that both methods have."""
    a, b = (df.select(F.col(key), F.col(method).alias(s), F.col(value).alias(f"v{s}")) for s in "ab")
    d = a.join(b, key).filter("a < b").withColumn("d", F.col("vb") - F.col("va"))
    tie = F.abs("d") <= 1e-12
    return d.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.percentile("d", 0.5).alias("median"),
        F.count(F.when(~tie & (F.col("d") > 0), 1)).alias("wins"), F.count(F.when(tie, 1)).alias("ties"), F.count(F.when(~tie & (F.col("d") < 0), 1)).alias("losses"),
    )


def average_rank(c: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.orderBy(c)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho over aggregated entities (a row for each)."""
    return df.select(average_rank(a).alias("ra"), average_rank(b).alias("rb")).agg(F.corr("ra", "rb").alias("rho"))


def bootstrap_mean(df: DataFrame, value: str, unit: str, draws: int, seed: int) -> DataFrame:
    """mean, lo, hi (2.5 and 97.5 percent): Poisson bootstrap; each unit's weight in a draw comes from a hash, so draws run side by side."""
    from ..sources.fixtures import uniform

    units = df.groupBy(unit).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = uniform(seed, "draw", unit)
    cdf, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        cdf.append(total)
        term /= k + 1
    weight = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    means = each.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def mcnemar(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, only_a, only_b (rows right under one method alone), p: the exact two-sided binomial test."""
    right_a, right_b = F.col(a) == F.col("label"), F.col(b) == F.col("label")
    counts = df.groupBy(*by).agg(F.count(F.when(right_a & ~right_b, 1)).alias("only_a"), F.count(F.when(~right_a & right_b, 1)).alias("only_b"))

    @F.pandas_udf("double")
    def tail(x, y):  # noqa: ANN001, ANN202
        from math import exp, lgamma, log

        def p(i: int, j: int) -> float:
            n, k = i + j, min(i, j)
            return min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) - n * log(2)) for m in range(k + 1)))

        return x.combine(y, p).astype(float)

    return counts.withColumn("p", tail("only_a", "only_b"))


def holm(df: DataFrame, p: str, by: list[str], tie: str) -> DataFrame:
    """df with adjusted: Holm's step-down p within each cohort."""
    w = Window.partitionBy(*by).orderBy(p, tie)
    step = F.least(F.col(p) * (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(w) + 1), F.lit(1.0))
    return df.withColumn("_step", step).withColumn("adjusted", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def degree_strata(c: Column, low: int = 15, medium: int = 200) -> Column:
    return F.when(c <= low, "low").when(c <= medium, "medium").otherwise("high")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def quantile_profile(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, population deviation and quantiles; null when empty."""
    names = {"min": F.min(value), "q25": F.percentile(value, 0.25), "median": F.percentile(value, 0.5), "q75": F.percentile(value, 0.75), "p90": F.percentile(value, 0.9), "p95": F.percentile(value, 0.95), "p99": F.percentile(value, 0.99), "max": F.max(value)}
    return df.groupBy(*(by or [])).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *(x.alias(n) for n, x in names.items()))
