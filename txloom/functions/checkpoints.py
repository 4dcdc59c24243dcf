"""Reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Where it names none, one of our own if all runs on this machine (tests); on a cluster that would be the driver's disk, so
    there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


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


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet, where large tables take less room than in a checkpoint; its exchanges go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)
