"""The training corpus: quality, near-duplicates, secrets, mixture, packing.

Each stage works on all that the one before it kept. Stages 1 to 4 return the columns of documents, the last one returns
packed pieces. run() writes each stage to the shared folder and reads it again, as the driver of the stages does, so a lost
executor costs one stage's tasks at most; a stage's table goes once the next one is written.

For all stages: further columns are left out, an empty table gives an empty table, and texts are whole whatever their length.
Rows are told apart by a hash of all their columns, never by doc_id, so null and repeated doc_ids keep their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.llm import mixing, packing, quality, secret_scan, similar
from txloom.llm.common import row_key, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer does not take for junk.

    Texts without words (null, empty, white space) are junk. Rows of equal text are kept or rejected together.
    """
    return quality.scored(docs, keep=COLUMNS).filter(F.col("score") < quality.REJECT).select(*COLUMNS)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, with the least doc_id; a null doc_id only where no other is.

    Texts without words (null, empty, white space) are one group. Of rows that agree in all columns one stays; ties of doc_id
    in a group go to the least row hash.
    """
    keyed = docs.select(*COLUMNS, row_key(COLUMNS).alias("key"))
    groups = similar.groups(keyed.select("key", "text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = keyed.select("key", "doc_id").distinct().join(groups.distinct(), "key").groupBy("root").agg(F.min(order).alias("m")).select("m.key")
    return keyed.dropDuplicates(["key"]).join(first, "key", "left_semi").select(*COLUMNS)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span that the ledger has for their text replaced by [SECRET]; n_chars follows.

    A null text stays null, with null n_chars. Repeated rows stay repeated.
    """
    _, ledger = secret_scan.scan(docs)
    out = secret_scan.redacted(docs.select("doc_id", "text", "lang", "source"), ledger)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes.

    Texts without words are never taken. A null source is a source. Repeated rows are documents of their own.
    """
    return mixing.mixture(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents with their places in sequences.

    A null or empty text is its end token alone. Repeated rows are packed like any others.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", first_of_near_duplicates),
    ("secret scans", secrets_redacted),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]

#: SQL has no expectation-maximisation, no SimHash and no tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def gone(spark: SparkSession, path: str) -> None:
    """Removes a folder of a store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            gone(spark, f"{home}/{k - 1}")
    return docs
