"""SimHash near-duplicates by similarity: word shingles with a Jaccard similarity of at least 4/5.

Operator 8's contract asks for fingerprints at most 3 bits apart; texts that share four fifths of their shingles mostly are
farther apart (their 64-bit fingerprints differ in about 10 bits). So here the fingerprint has BITS bits, and the exact
radius gives way to tables of partial distances:

* two sets with cosine c differ in a share of acos(c) / pi of the bits: 0.1515 at a similarity of 4/5;
* each table has a reference pattern over BITS_EACH(N) of the bits, drawn once; rows meet in a table where their distances to
  each single bit of the pattern agree. The number of tables follows from MISS: a pair at the very threshold meets in
  none of them with that probability at most, one at 0.9 with less than a hundredth of that;
  So a table's sampled bits are a block whose pivots are the join key, as in operator 8;
* the pivot table has each node's distances to reference fingerprints, computed once and stored: one drawn reference and all
  that differ from it by inverting some of its BLOCKS blocks of four bits. A coordinate is a sum over blocks of the
  block's distance, or of four minus it, so the greatest coordinate difference of two nodes over all 2^64 references is the
  sum of the blocks' differences, and the blocks' distances are all that the table holds. By the triangle inequality a pair
  at distance d differs by at most d in each coordinate, so pairs whose greatest difference exceeds LIMIT are discarded
  before their fingerprints are looked at, and none within LIMIT is lost. Of random pairs that discards 39 of 40;
* of the pairs left, those farther than LIMIT bits go, and the others are verified on their whole sets of shingles, so no two
  texts below the threshold are ever linked.

A few drawn references could discard nothing at this radius: in such a coordinate two random fingerprints of 256 bits differ
by 11 in the mean, and a pair may differ by LIMIT = 56. Inverted blocks make the differences of all blocks count.

Texts with equal words (letters A-Z lower-cased) are one node, so copies never form pairs. In each bucket, every node is first
compared with one node of the bucket; tables are of HUBS kinds, each with an order of its own, so a node of a large group has
about so many pairs and not one for each table. Buckets whose nodes then are of one component are done;
in the others, nodes outside the largest component are compared with all. There an odd sketch (a bit for the parity of
the shingles in each of ODD parts; sets that differ in s shingles differ in at most s parities) refutes pairs inside the join
without loss, so a large group of copies that are not quite similar enough doesn't list its pairs.

Texts without words are one node. Nulls are empty. Repeated rows are rows of one node. Texts are never cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, swept, texts, tidy
from .components import connected
from .simhash import UPPER

WIDTH, BITS, ODD = 5, 256, 1024
#: Share of the bits in which two sets of one size differ at a similarity of 4/5.
APART = math.acos(8 / 9) / math.pi
MISS, LEAST_TABLES = 0.05, 64
#: A power of two.
HUBS = 4
#: 2.8 deviations above the mean distance at a similarity of 4/5: one pair of 400 there is farther apart.
LIMIT = 56
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
SALTS = np.array([xxhash.xxh64_intdigest(bytes([i]), 9) | 1 for i in range(BITS // 64)], np.uint64)
FP = [f"f{i}" for i in range(BITS // 64)]
PARITY = [f"o{i}" for i in range(ODD // 64)]
#: The pivot table: the distances (0 to 4) of BLOCKS blocks of four bits to the reference's. Each is held as so many ones, so the
#: sum of two rows' differences is the number of bits in which they differ.
BLOCKS = BITS // 4
PIVOTS = [f"p{i}" for i in range(BITS // 64)]
REFERENCE = np.array([xxhash.xxh64_intdigest(bytes([i]), 10) for i in range(BITS // 64)], np.uint64)
ONES = np.array([(1 << (x & 15).bit_count()) - 1 | (1 << (x >> 4).bit_count()) - 1 << 4 for x in range(256)], np.uint8)


class Hashes(dict):
    """Hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 5)
        return h


def shingles(words: list[bytes], known: Hashes, width: int = WIDTH) -> np.ndarray:
    """The set of the hashes, ascending; a text of fewer words has one shingle, one without words none."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """BITS bits, as 64-bit words: 1 where over half of the shingles have it."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), BLOCK):
        x = h[a : a + BLOCK, None] * SALTS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of ODD parts."""
    part = (h >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=ODD) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def pivot_distances(fingerprint: np.ndarray) -> np.ndarray:
    """A row of the pivot table."""
    return ONES[(fingerprint ^ REFERENCE).view(np.uint8)].view(np.uint64)


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 6) - (1 << 63)


def over_texts(docs: DataFrame, each: Callable[[list], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    """Rows that each() gives for (key, words) of a slice, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(k, t.translate(UPPER).split()) for k, t in zip(batch.column("key").to_pylist(), texts(batch.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays(each(rows), names)

    return docs.select("key", "text").mapInArrow(run, schema)


def marks(docs: DataFrame) -> DataFrame:
    """key, node, n (size of its set), the wide fingerprint, its pivot distances and the odd sketch, for each row."""
    known = Hashes()

    def each(rows: list) -> list[pa.Array]:
        seen: dict[int, tuple] = {}
        nodes = []
        for _, words in rows:
            nodes.append(node_of(words))
            if nodes[-1] not in seen:
                h = shingles(words, known)
                fp = wide_fingerprint(h)
                seen[nodes[-1]] = (len(h), np.concatenate((fp, pivot_distances(fp), odd_sketch(h))).view(np.int64))
        wide = np.array([seen[v][1] for v in nodes], np.int64).reshape(len(nodes), len(FP) + len(PIVOTS) + len(PARITY))
        return [pa.array([k for k, _ in rows], pa.int64()), pa.array(nodes, pa.int64()), pa.array([seen[v][0] for v in nodes], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in wide.T)]

    names = ["key", "node", "n", *FP, *PIVOTS, *PARITY]
    return over_texts(docs, each, ", ".join(f"{c} long" for c in names), names)


def sets(docs: DataFrame) -> DataFrame:
    """node, h (its shingles' hashes), maybe several times."""
    known = Hashes()

    def each(rows: list) -> list[pa.Array]:
        found = {node_of(w): w for _, w in rows}
        return [pa.array(list(found), pa.int64()), pa.array([shingles(w, known).tobytes() for w in found.values()], pa.binary())]

    return over_texts(docs, each, "node long, h binary", ["node", "h"])


def tables(n_nodes: int) -> list[list[int]]:
    """For each table the masks of its reference pattern, one a fingerprint word."""
    each = max(8, math.ceil(math.log2(max(n_nodes, 1) + 1)) + 1)
    count = max(LEAST_TABLES, math.ceil(math.log(MISS) / math.log(1 - (1 - APART) ** each)))
    r = np.random.default_rng(8)
    chosen = (r.choice(BITS, each, replace=False) for _ in range(count))
    return [[sum(1 << int(b) % 64 for b in bits if b // 64 == w) for w in range(BITS // 64)] for bits in chosen]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """key, node for each node and table."""
    hashed = [F.xxhash64(F.lit(t), *(F.col(f).bitwiseAND(F.lit(signed(m))) for f, m in zip(FP, masks, strict=True) if m)) for t, masks in enumerate(tables(n_nodes))]
    keys = [h.bitwiseAND(F.lit(-HUBS)).bitwiseOR(F.lit(t % HUBS)) for t, h in enumerate(hashed)]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def mask() -> Column:
    """What a bucket's nodes are compared under to find the least: one of HUBS, by the table that the key tells."""
    return F.xxhash64(F.col("key").bitwiseAND(F.lit(HUBS - 1)))


def differing(columns: list[str]) -> Column:
    """Bits in which the columns of sides a and b differ."""
    return sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in columns), F.lit(0))


def sided(df: DataFrame, side: str, columns: list[str], *rest: str) -> DataFrame:
    return df.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns), *rest)


def sizes_fit() -> Column:
    """9 overlap >= 4 (n_a + n_b) says that the similarity is at least 4/5; so at most a ninth of n_a + n_b differ."""
    return 9 * F.least("n_a", "n_b") >= 4 * (F.col("n_a") + F.col("n_b"))


def verified(pairs: DataFrame, have: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least 4/5."""
    both = pairs.join(have.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(have.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, h of the wanted nodes; each is read from one of its rows."""
    some = nodes.join(wanted, "node", "left_semi").select(F.col("at").alias("key"))
    return cut(sets(docs.select("key", "text").join(some, "key", "left_semi")).dropDuplicates(["node"]))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def near_in_pivots() -> Column:
    """The greatest coordinate difference of sides a and b is at most LIMIT."""
    return differing(PIVOTS) <= LIMIT


def star_pairs(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of each node with one node of each of its buckets, within LIMIT bits.

    The pivot table discards first; fingerprints are looked up for what it leaves.
    """
    hub = F.col("lo").bitwiseXOR(mask())
    near = rows.select(hub.alias("a"), F.col("node").alias("b")).filter("a <> b")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for columns, fit in ((["n", *PIVOTS], sizes_fit() & near_in_pivots()), (FP, differing(FP) <= LIMIT)):
        near = near.join(sided(nodes, "a", columns), "a").join(sided(nodes, "b", columns), "b").filter(fit).select("a", "b")
    return near


def pairs_between(nodes: DataFrame, rows: DataFrame, coarse: DataFrame) -> DataFrame:
    """Pairs of nodes that share a bucket but no component and that neither the pivot table, the limit nor the odd sketch refutes.

    rows: key, node in buckets of three nodes or more. Of each bucket, nodes outside its largest component meet all others.
    """
    named = rows.join(coarse, "node")
    count = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    # written before the join, here and below, so that both its sides are exchanges and a hot key can be split
    most = cut(count.groupBy("key").agg(F.max_by("comp", "c").alias("most"), F.count("*").alias("comps")).filter("comps > 1").select("key", "most"))
    columns = ["n", "comp", *PIVOTS, *FP, *PARITY]
    full = cut(named.join(most, "key").join(nodes, "node").select("node", "key", "most", *columns))
    a = sided(full.filter("comp <> most"), "a", columns, "key", "most")
    b = sided(full, "b", columns, "key")
    fit = (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("most")) | (F.col("a") < F.col("b")))
    fit = fit & sizes_fit() & near_in_pivots() & (differing(FP) <= LIMIT) & (9 * differing(PARITY) <= F.col("n_a") + F.col("n_b"))
    return a.join(b.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """key, root (equal for the rows of a component of near-duplicates), for each row of docs (key, text)."""
    with swept(docs.sparkSession):
        return _groups(docs)


def _groups(docs: DataFrame) -> DataFrame:
    marked = cut(marks(docs))
    nodes = cut(marked.groupBy("node").agg(F.min("key").alias("at"), *(F.first(c).alias(c) for c in ("n", *FP, *PIVOTS, *PARITY))))
    every = buckets(nodes, nodes.count())
    least = F.col("node").bitwiseXOR(mask())
    shared = every.groupBy("key").agg(F.min(least).alias("lo"), F.max(least).alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("key", "lo", "c")
    shared = cut(shared)
    rows = cut(every.join(shared, "key").select("key", "node", "lo", "c"))
    del every, shared
    tidy(docs.sparkSession)
    near = cut(star_pairs(nodes, rows))
    have = sets_of(docs, nodes, ends(near))
    tidy(docs.sparkSession)
    coarse = cut(connected(nodes.select("node"), verified(near, have)))
    more = cut(pairs_between(nodes, rows.filter("c > 2").select("key", "node"), coarse))
    lacking = cut(ends(more).join(have.select("node"), "node", "left_anti"))
    if not lacking.isEmpty():
        have = have.union(sets_of(docs, nodes, lacking))
    links = cut(verified(more, have))
    del rows, near, have, more, lacking
    tidy(docs.sparkSession)
    named = links.join(coarse.select(F.col("node").alias("a"), F.col("comp").alias("u")), "a").join(coarse.select(F.col("node").alias("b"), F.col("comp").alias("v")), "b")
    merged = connected(coarse.select(F.col("comp").alias("node")).distinct(), named.select(F.col("u").alias("a"), F.col("v").alias("b")))
    merged = cut(merged.select(F.col("node").alias("comp"), F.col("comp").alias("root")))
    return marked.select("key", "node").join(coarse, "node").join(merged, "comp").select("key", "root")
