"""Sinks: sorted and bucketed Parquet, content-addressed stores, prediction files, run folders, identities."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import LocalFiles, SparkFiles, write_whole


def sorted_parquet(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Ranges of the order, sorted within, zstd: scans then prune row groups by their statistics."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def by_entity(df: DataFrame, table: str, key: str, buckets: int, order: list[str]) -> None:
    """A table bucketed by an entity in the warehouse, so that joins and windows on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)


def predictions(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).option("compression", "gzip").csv(path)


def row_identity(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and digest: independent of order and partitions, as each row's SHA-256 is folded by xor and by sum."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    low, high = (F.conv(F.substring(h, a, 15), 16, 10).cast("long") for a in (1, 16))
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*"), F.bit_xor(low), F.bit_xor(high), F.sum(F.pmod(low, F.lit(1 << 31)))), 256).alias("digest"))


def column_digest(c: Column, order: Column) -> Column:
    """SHA-256 of a small group's values in order."""
    return F.sha2(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), c.cast("string").alias("v")))), lambda s: s["v"])), 256)


def content_store(spark: SparkSession, home: str, identity: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table built for this identity: made once, in a folder named after the identity's digest, complete by its manifest.

    The manifest is written last, through Spark, so it works on any store; one that speaks of another identity is an error.
    """
    digest = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()
    path = f"{home}/{digest[:24]}"
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        found = spark.read.json(f"{path}/manifest").first()["digest"]
        if found != digest:
            raise ValueError(f"{path} belongs to {found}")
    else:
        build().write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(digest, json.dumps(identity, sort_keys=True))], "digest string, identity string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.parquet(f"{path}/data")


def json_bytes(value: object) -> bytes:
    return json.dumps(value, indent=1, sort_keys=True, allow_nan=False).encode()


def array_bytes(**arrays: object) -> bytes:
    """Named arrays as a compressed NumPy archive."""
    import numpy as np

    with io.BytesIO() as f:
        np.savez_compressed(f, **arrays)
        return f.getvalue()


def write_json(path: str | Path, value: object, tries: int = 5, spark: SparkSession | None = None) -> None:
    """A JSON file, whole or not there; on any file system with a session, on the local disk without."""
    write_whole(SparkFiles(spark) if spark else LocalFiles(), str(path), json_bytes(value), tries)


class Run:
    """A run folder: running, then complete, interrupted or failed; a lock keeps a second process out; attempts are counted.

    With a session the folder may be on any file system that Spark reads.
    """

    def __init__(self, path: str | Path, spark: SparkSession | None = None) -> None:
        self.path, self.files = str(path), SparkFiles(spark) if spark else LocalFiles()

    def status(self) -> dict:
        file = f"{self.path}/status.json"
        return json.loads(self.files.read(file)) if self.files.exists(file) else {"status": "new", "attempts": 0}

    def _write(self, status: dict) -> None:
        write_whole(self.files, f"{self.path}/status.json", json_bytes(status))

    def __enter__(self) -> Run:
        before = self.status()
        if before["status"] == "complete":
            raise ValueError(f"{self.path} is complete")
        self.files.create(f"{self.path}/lock", b"")
        self._write({"status": "running", "attempts": before["attempts"] + 1})
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, _: object) -> None:
        status = "complete" if kind is None else "interrupted" if kind is KeyboardInterrupt else "failed"
        self._write(self.status() | {"status": status} | ({"error": str(error)} if error else {}))
        self.files.remove(f"{self.path}/lock")
