"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a float sum doesn't show; -0.0 becomes 0.0. Dates are written as text."""
    shown = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: c.cast("string")}
    return df.select(*(shown[k](F.col(f"`{c}`")).alias(c) if k in shown else F.col(f"`{c}`") for c, k in df.dtypes))


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; its doubles are rounded."""

    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


from . import q_aggregates, q_encoders, q_graph, q_history, q_metrics, q_model, q_projections, q_relational, q_sampling, q_sources, q_splits, q_streaming  # noqa: E402, F401
