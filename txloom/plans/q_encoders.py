"""Queries over train-only encoders (ENC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoders as E
from ..operators import splits as S
from ..sources.fixtures import transactions
from .q_history import X
from .q_projections import _SPLIT
from .registry import query

TR = f"{_SPLIT}, tr AS (SELECT * FROM s WHERE split = 'train')"


def both(spark, d):  # noqa: ANN001, ANN201
    s = S.tie_safe_split(transactions(spark, d))
    return s.filter("split = 'train'"), s


_MM = "(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM tr)) - (SELECT min(amount) FROM tr)) / (SELECT CASE WHEN max(amount) > min(amount) THEN max(amount) - min(amount) ELSE 1 END FROM tr)"


@query("enc1_minmax", f"WITH {TR} SELECT tx_id, round({_MM}, 6) AS x FROM s")
def _(spark, d):
    return E.minmax(*both(spark, d), "amount", "x").select("tx_id", "x")


@query("enc2_minmax_clipped", f"WITH {TR} SELECT tx_id, round(greatest(least({_MM}, 1.0), 0.0), 6) AS x FROM s")
def _(spark, d):
    return E.minmax(*both(spark, d), "amount", "x", clipped=True).select("tx_id", "x")


@query("enc3_robust", f"WITH {TR}, q AS (SELECT quantile_cont({X}, 0.25) AS a, quantile_cont({X}, 0.5) AS b, quantile_cont({X}, 0.75) AS c FROM tr) SELECT tx_id, round(greatest(least((coalesce({X}, b) - b) / CASE WHEN c > a THEN c - a ELSE 1 END, 10.0), -10.0), 6) AS x FROM s, q")
def _(spark, d):
    return E.robust(*both(spark, d), "amount", "x").select("tx_id", "x")


@query("enc4_standard", f"WITH {TR}, q AS (SELECT avg(amount) AS a, stddev_pop(amount) AS b, avg(ln(1 + greatest(0, amount))) AS c, stddev_pop(ln(1 + greatest(0, amount))) AS e FROM tr) SELECT tx_id, round((amount - a) / b, 6) AS x, round((ln(1 + greatest(0, amount)) - c) / e, 6) AS y FROM s, q")
def _(spark, d):
    train, df = both(spark, d)
    return E.standard(train, E.standard(train, df, "amount", "x"), E.log_amount("amount"), "y").select("tx_id", "x", "y")


@query("enc5_ordinal", f"WITH {TR}, c AS (SELECT user_key, row_number() OVER (ORDER BY user_key)::INT AS code FROM (SELECT DISTINCT user_key FROM tr)) SELECT tx_id, coalesce(code, 0)::INT AS code FROM s LEFT JOIN c USING (user_key)")
def _(spark, d):
    return E.ordinal(*both(spark, d), "user_key", "code").select("tx_id", "code")


@query("enc6_first_appearance", f"WITH {TR}, c AS (SELECT mcc, min(tx_id) AS f, count(*) AS n FROM tr GROUP BY mcc), k AS (SELECT mcc, n, (row_number() OVER (ORDER BY f) - 1) / (count(*) OVER ())::DOUBLE AS code FROM c), m AS (SELECT code FROM k ORDER BY n DESC, mcc LIMIT 1) SELECT tx_id, round(coalesce(k.code, m.code), 6) AS code FROM s LEFT JOIN k USING (mcc), m")
def _(spark, d):
    return E.first_appearance(*both(spark, d), "mcc", "code").select("tx_id", "code")


_HOT = ["F", "O", "P"]


@query("enc7_one_hot", f"WITH {TR} SELECT tx_id, " + ", ".join(f"""(channel IS NOT NULL AND channel = '{v}')::INT AS "channel={v}" """ for v in _HOT) + f""", (channel IS NOT NULL AND channel NOT IN ('F', 'O', 'P'))::INT AS "channel=<oov>", (channel IS NULL)::INT AS "channel=<missing>" FROM s""")
def _(spark, d):
    return E.one_hot(*both(spark, d), "channel").select("tx_id", *(f"`channel={v}`" for v in [*_HOT, "<oov>", "<missing>"]))


@query("enc8_sparse_matrix")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    train, df = both(spark, d)
    return E.sparse_matrix(train, df, ["channel", "mcc"], ["amount"]).select("tx_id", vector_to_array("features").alias("arr")).select("tx_id", F.size("arr").alias("width"), F.aggregate("arr", F.lit(0.0), lambda a, x: a + x).alias("total"))


_FREQ = f"{TR}, c AS (SELECT city_key, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS f FROM tr GROUP BY city_key)"


@query("enc9_frequency", f"WITH {_FREQ} SELECT tx_id, round(coalesce(f, 0), 6) AS f, (coalesce(f, 0) = 0)::INT AS f_oov FROM s LEFT JOIN c USING (city_key)")
def _(spark, d):
    return E.frequency(*both(spark, d), "city_key", "f").select("tx_id", "f", "f_oov")


@query("enc10_surprisal", f"WITH {_FREQ} SELECT tx_id, round(-ln(greatest(coalesce(f, 1e-9), 1e-9)) / 20, 6) AS f_surprisal FROM s LEFT JOIN c USING (city_key)")
def _(spark, d):
    return E.frequency(*both(spark, d), "city_key", "f").select("tx_id", "f_surprisal")


_PI = "3.141592653589793::DOUBLE"


@query("enc11_cyclic", "SELECT event_id, " + ", ".join(f"round({w}({x} * (2 * {_PI} / {p})), 6) + 0.0::DOUBLE AS {n}_{w}" for n, x, p in (("hour", "(hour(ts) + minute(ts) / 60.0::DOUBLE)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "(month(ts) - 1)", 12)) for w in ("sin", "cos")) + ", (isodow(ts) >= 6)::INT AS weekend FROM events")
def _(spark, d):
    from ..sources.fixtures import table

    names = [f"{n}_{w}" for n in ("hour", "dow", "month") for w in ("sin", "cos")]
    return E.cyclic(table(spark, d, "events")).select("event_id", *names, "weekend")


@query("enc12_flags", f"WITH {_SPLIT} SELECT tx_id, (channel = 'O')::INT AS online, (errors_key IS NOT NULL)::INT AS has_error, coalesce(amount < 0, FALSE)::INT AS refund, (amount IS NULL)::INT AS amount_missing FROM s")
def _(spark, d):
    return E.flags(both(spark, d)[1]).select("tx_id", "online", "has_error", "refund", "amount_missing")


@query("enc13_leaky_ordinal", f"WITH {_SPLIT} SELECT tx_id, (dense_rank() OVER (ORDER BY user_key))::INT AS code FROM s")
def _(spark, d):
    s = both(spark, d)[1]
    return E.ordinal(s, s, "user_key", "code").select("tx_id", "code")  # fitted on all rows: the documented leaky baseline


@query("enc14_log_amount", f"WITH {_SPLIT} SELECT tx_id, round(ln(1 + greatest(0, amount)), 6) AS x FROM s")
def _(spark, d):
    return both(spark, d)[1].select("tx_id", E.log_amount("amount").alias("x"))


@query("enc15_feature_family", f"WITH {_SPLIT} SELECT tx_id, amount, channel FROM s")
def _(spark, d):
    return E.family(both(spark, d)[1], "clean_basic")
