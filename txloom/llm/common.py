"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java, RE2 and Python alike. bytes.split() splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, written to the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints of tables that nothing refers to any more.

    It learns of them when the driver's garbage is collected, which else may be long after. What the first collection lets
    go of in Python and in plans, the second one finds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """In here, the exchanges of a step are removed as soon as its action ends, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def row_key(columns: list[str]) -> Column:
    """A hash of the whole row that tells a null from any value; equal only for rows that repeat one another."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns), F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in columns)))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null and for white space only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about most_bytes of a text column each, so memory is bounded whatever the batch size."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
