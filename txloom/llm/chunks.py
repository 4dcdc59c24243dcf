"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last 32 bytes has zeros under a mask. The chunking is normalised:
before the target length a mask with two more bits makes cuts rare, after it one with two bits fewer makes them frequent,
and the greatest length is a cut at any rate. Cuts depend on nearby content alone, so after an insertion the chunks fall
into step again. A fingerprint is the set of chunk digests, each weighted by its chunk's length; likeness is the weight
of the digests that another fingerprint has too, over all its weight (containment).

A null text is the empty text. Empty fingerprints contain each other wholly (1.0); an empty one holds nothing of
another, and an empty text is 0.0 like a text that isn't empty. Equal texts have equal fingerprints. Repeated rows and
equal doc_ids are rows of their own, in the order of doc_id and text; null doc_ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Least, target and greatest bytes of a chunk.
LEAST, TARGET, MOST = 32, 128, 512
#: Bytes that are hashed at a time.
BLOCK = 1 << 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 5) for i in range(256)], np.uint32)
HARD, EASY = (np.uint32(((1 << n) - 1) << (32 - n)) for n in (10, 6))


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of GEAR[b[i - j]] << j for j under 32, mod 2**32, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        step = h.copy()
        step[k:] += h[:-k] << np.uint32(k)
        h = step
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    data = np.frombuffer(text, np.uint8)
    easy, hard = [], []
    for a in range(0, n, BLOCK):
        before = min(a, 31)
        h = gear(data[a - before : a + BLOCK])[before:]
        at = np.flatnonzero((h & EASY) == 0)
        easy.append(at + a + 1)
        hard.append(at[(h[at] & HARD) == 0] + a + 1)
    easy, hard = np.concatenate(easy), np.concatenate(hard)
    out, start = [], 0
    while n - start > LEAST:
        low, aim, high = start + LEAST, start + TARGET, min(start + MOST, n)
        i = int(np.searchsorted(hard, low))
        if i < len(hard) and hard[i] < min(aim, high):
            end = int(hard[i])
        else:
            i = int(np.searchsorted(easy, max(low, aim)))
            end = int(easy[i]) if i < len(easy) and easy[i] < high else high
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_set(text: bytes) -> dict[str, int]:
    """Digest and weight of the chunks; equal chunks add their lengths."""
    out: dict[str, int] = {}
    start = 0
    for end in cuts(text):
        d = xxhash.xxh3_64_hexdigest(text[start:end])
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """How much of a is in b; at most the weight b has of a chunk counts."""
    if not a or not b:
        return float(not a and not b)
    return sum(min(w, b.get(d, 0)) for d, w in a.items()) / sum(a.values())


def written(chunks: dict[str, int]) -> str:
    return ",".join(f"{d}:{w}" for d, w in sorted(chunks.items()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (digest:weight, comma-joined, by digest), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([written(chunk_set(t)) for t in texts(batch.column("text"))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows in ranges of doc_id, each range in one partition and sorted down, with the first row of the next range after it.

    Columns: part, lent (true for the added row), doc_id, text. The range bounds are quantiles, at most one for each task,
    so the driver gets a bounded list; texts are exchanged once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = sorted(set(rows.select(F.percentile_approx("doc_id", [k / tasks for k in range(1, tasks)], 10_000)).first()[0] or []), reverse=True)
    none = F.col("doc_id").isNull()
    part = F.lit(len(bounds))
    if bounds:  # part: the number of bounds above the doc_id
        lists, steps = F.array(*map(F.lit, bounds)), F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
        halved = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lists, at + step - 1) > F.col("doc_id"), at + step).otherwise(at))
        part = F.when(none, len(bounds)).otherwise(halved)
    first = rows.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).orderBy("part").collect()
    tops = {r["part"]: r["top"] for r in first}
    order = [r["part"] for r in first]
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range is lent to the last
    by_part = lambda table, kind: F.element_at(F.array(*(F.lit(table.get(p)).cast(kind) for p in range(len(bounds) + 1))), part + 1)
    to = F.when(F.col("doc_id").eqNullSafe(by_part(tops, "long")), by_part(before, "int"))
    owned = F.struct(part.cast("int").alias("part"), F.lit(False).alias("lent"))
    lent = F.struct(to.alias("part"), F.lit(True).alias("lent"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(to.isNull(), F.array(owned)).otherwise(F.array(owned, lent))).alias("x"))
    dealt = dealt.select("x.part", "x.lent", "doc_id", "text")
    return dealt.repartition(len(order) or 1, "part").sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each row's fingerprint against its edited text's and the next document's (doc_id descending, after the last the first)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor is still to come: part, doc_id, text, chunks
        out: list[list] = [[] for _ in names]

        def take(following: str, chunks: dict[str, int]) -> None:
            _, doc_id, text, own = held
            changed = edited(text, following)
            theirs = chunk_set(changed.encode())
            row = (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(own), written(theirs), likeness(own, theirs), likeness(own, chunks))
            for kept, x in zip(out, row, strict=True):
                kept.append(x)

        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        for batch in slices(batches, "text"):
            for part, lent, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "lent", "doc_id", "text")), strict=True):
                chunks = chunk_set(text.encode())
                if held is not None and held[0] == part:
                    take(text, chunks)
                # of several rows lent (equal doc_ids), the first is the next range's first
                held = None if lent else (part, doc_id, text, chunks)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
            out = [[] for _ in names]

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, tasks).mapInArrow(run, kinds)
