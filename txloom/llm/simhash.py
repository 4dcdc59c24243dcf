"""SimHash near-duplicates through pivot distance tables.

A fingerprint's distances to many reference fingerprints are computed once and stored. By the triangle
inequality a pair at Hamming distance d differs by at most d in every coordinate, so a pair whose largest
coordinate difference exceeds the limit is discarded without comparing the fingerprints.

A table of whole-fingerprint distances alone can only be scanned pair by pair, so the table has two parts:

* *block pivots*: the 64 bits are cut into BLOCKS blocks, and each block has its own reference patterns. Of
  two fingerprints at most LIMIT bits apart, at least BLOCKS - LIMIT blocks agree, and there every
  coordinate difference is 0. Each choice of BLOCKS - LIMIT blocks gives one equi-join on those coordinates,
  and together they miss no pair;
* *whole pivots*: pseudo-random fingerprints. Candidates whose maximum coordinate difference exceeds LIMIT
  are discarded, and the survivors are verified.

Ranges of whole coordinates can't choose the candidates: two random fingerprints differ by 5.7 in the mean square there, so
a range of LIMIT either way holds half of all rows, while cells of that width put each row in two of them. A coordinate
would cost as much as it saves. In a block that agrees, the difference is 0, and a coordinate halves the rows at no cost.

Distinct fingerprints are the nodes, so copies never form pairs. Groups of many close fingerprints are first
contracted by exact one-bit links (64 keys for each node, no pairs). A bucket whose nodes are all in one
component is dropped before pairs are made; in the others, only nodes outside the bucket's largest component are paired
with all, so neither a dense group nor a stranger in its bucket gives the square of the group's size.

Nulls and texts without words have fingerprint zero and link like any other. Repeated rows stay repeated. A
null doc_id never is a component's id unless no member has one. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts
from .components import connected

SEED, WIDTH, LIMIT, BLOCKS, WHOLE_PIVOTS = 42, 3, 3, 6, 16
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit b is 1 where over half of the shingles' XXH64 have it."""
    words = text.translate(UPPER).split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    h = np.fromiter([hashed(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: dict[bytes, int] = {}
            out = []
            for t in texts(batch.column("text")):
                if t not in known:
                    known[t] = fingerprint(t, width, seed)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def blocks(n: int = BLOCKS) -> list[int]:
    """Masks of n runs of bits that cover all 64."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(signed(b)) if isinstance(b, int) else b))


def block_pivots(fp: Column, mask: int) -> list[Column]:
    """Distances of a block to the pattern of no ones and to each pattern of a single one."""
    part = fp.bitwiseAND(F.lit(signed(mask)))
    return [distance(part, 0), *(distance(part, 1 << i) for i in range(64) if mask >> i & 1)]


def whole_pivots(fp: Column, n: int = WHOLE_PIVOTS) -> list[Column]:
    return [distance(fp, xxhash.xxh64_intdigest(str(i), 7)) for i in range(n)]


def buckets(nodes: DataFrame, limit: int = LIMIT, n_blocks: int = BLOCKS) -> DataFrame:
    """A row for each node and choice of n_blocks - limit blocks; key: the choice and these blocks' coordinates."""
    coordinates = [F.xxhash64(*block_pivots(F.col("fp"), m)) for m in blocks(n_blocks)]
    table = nodes.select(*nodes.columns, *(c.alias(f"c{i}") for i, c in enumerate(coordinates)))
    keys = [F.xxhash64(F.lit(k), *(F.col(f"c{i}") for i in some)) for k, some in enumerate(itertools.combinations(range(n_blocks), n_blocks - limit))]
    return table.select(*nodes.columns, F.explode(F.array(*keys)).alias("key"))


def one_bit_links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that differ in one bit, by looking up each node's lower neighbours."""
    flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = nodes.select(F.col("fp").alias("a"), F.explode(F.filter(flipped, lambda x: x < F.col("fp"))).alias("b"))
    return near.join(nodes.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of components of nodes (fp, comp) that have members within the limit.

    A bucket in which all nodes are of one component gives nothing; in the others its largest component meets the rest only.
    """
    rows = buckets(nodes, limit)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    rows = cut(rows.join(mixed, "key", "left_semi"))
    most = cut(rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", "c").alias("most")))
    table = rows.join(most, "key").withColumn("pivots", F.array(*whole_pivots(F.col("fp"))))
    a, b = (table.select("key", "most", *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "comp", "pivots"))) for side in "ab")
    far = F.greatest(*(F.abs(F.col("pivots_a")[i] - F.col("pivots_b")[i]) for i in range(WHOLE_PIVOTS)))
    once = (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("most")) | (F.col("comp_a") < F.col("comp_b")))
    close = once & (far <= limit) & (distance(F.col("fp_a"), F.col("fp_b")) <= limit)
    near = a.filter("comp_a <> most").join(b.drop("most"), "key").filter(close)
    return near.select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for each row of docs."""
    marked = cut(fingerprints(docs))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    plain = nodes.select("fp")
    coarse = cut(connected(plain, one_bit_links(plain)).withColumnsRenamed({"node": "fp"}))
    merged = connected(coarse.select(F.col("comp").alias("fp")).distinct(), links(coarse, limit)).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    # written before the joins, so that their sides are exchanges and the rows of a large component can be split
    joined = cut(coarse.join(cut(merged), "comp").join(nodes, "fp").select("fp", "root", "least"))
    least = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = joined.join(least, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
