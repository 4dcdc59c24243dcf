"""Sharding by a k-d tree over metadata (DataFrame functions only).

A point is a group of rows with equal texts; its dimensions are metadata that its rows share or their least value.
Starting with all points, a node that holds several shards is split at the weighted median (for an odd number of
shards: the weighted quantile) of its widest dimension, until each leaf is one shard of about the target bytes.
Points of equal value in the dimension are in the order of a hash, so a hot value doesn't hinder the split.

A quantile is found exactly by histograms: each point has a 48-bit key in the split dimension (24 bits of the value
scaled to the dimension's range, 24 bits of a hash), and three rounds look at 16 bits each. The driver gets at most
2**16 sums for a node and round, whatever the number of rows.

Groups with over 1/HEAVY of a shard's bytes, of which there are at most shards * HEAVY, are dealt first, the largest
to the emptiest shard, and the tree's leaves get what is left. Only a group larger than a shard can't stay in one:
its rows are dealt by a hash into parts of about a quarter of a shard.

Laws: sizes are near equal (the law `bytes`). Null texts have no bytes and are equal to the empty text here. Repeated
rows are rows of their own. Null metadata count as the empty string. Fewer groups than shards leave shards empty;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, HEAVY = 8, 16
#: Bits of a key that a round looks at, and the number of rounds.
BITS, ROUNDS = 16, 3
ROWS = 4096


def size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def points(rows: DataFrame, metadata: list[str]) -> DataFrame:
    """A row for each group (k1, k2, part): bytes, a hash, and each dimension scaled to 0..2**24-1.

    Numbers are scaled linearly between their least and greatest value, other columns by their hash.
    """
    kinds = dict(rows.dtypes)
    found = rows.groupBy("k1", "k2", "part").agg(F.sum("size").alias("bytes"), *(F.min(c).alias(c) for c in metadata))
    numbers = [c for c in metadata if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    ends = found.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{e}") for c in numbers for e, f in (("lo", F.min), ("hi", F.max)))).first()

    def scaled(c: str) -> Column:
        if c not in numbers:
            return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), 40)
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.floor((F.coalesce(F.col(c), F.lit(lo)) - lo) / F.lit(float(hi - lo)) * F.lit(float((1 << 24) - 1)))

    return found.select("k1", "k2", "part", "bytes", F.shiftrightunsigned(F.xxhash64("k2", "k1", "part"), 40).alias("hash"), *(scaled(c).alias(f"d{i}") for i, c in enumerate(metadata)))


def heavy_groups(pts: DataFrame, total: int, shards: int) -> tuple[dict, list[int]]:
    """Shards of the heavy groups, largest first to the emptiest shard, and the bytes left in each shard."""
    target = total / shards
    heavy = pts.filter(F.col("bytes") > F.lit(target / HEAVY)).select("k1", "k2", "part", "bytes").collect()
    room, dealt = [target] * shards, {}
    for g in sorted(heavy, key=lambda g: (-g["bytes"], g["k1"], g["k2"], g["part"])):
        best = max(range(shards), key=lambda s: (room[s], -s))
        dealt[g["k1"], g["k2"], g["part"]] = best
        room[best] -= g["bytes"]
    return dealt, [max(r, 0) for r in room]


def lookup(key: Column, table: dict, default: int) -> Column:
    """A value by a small dictionary of literals; its size is bounded by the number of shards."""
    found = F.lit(default).cast("long")
    for k, v in table.items():
        found = F.when(key == k, F.lit(v).cast("long")).otherwise(found)
    return found


def tree(pts: DataFrame, room: list[int]) -> DataFrame:
    """pts with shard: the leaf of a k-d tree whose leaves hold parts of the bytes as room says."""
    dims = [c for c in pts.columns if c.startswith("d")]
    nodes = {0: (0, len(room))}
    pts = pts.withColumn("node", F.lit(0))
    while any(b - a > 1 for a, b in nodes.values()):
        stats = {r["node"]: r for r in pts.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(F.max(d) - F.min(d) for d in dims)).collect()}
        open_nodes = {n: (a, b) for n, (a, b) in nodes.items() if b - a > 1}
        widest = {n: max(range(len(dims)), key=lambda i: (stats[n][i + 2], -i)) if n in stats else 0 for n in open_nodes}
        aim = {}
        for n, (a, b) in open_nodes.items():
            middle = (a + b) // 2
            part, whole = sum(room[a:middle]), sum(room[a:b])
            aim[n] = (stats[n]["bytes"] if n in stats else 0) * (part / whole if whole else 0.5)
        value = F.col(dims[0])
        for n, i in widest.items():
            value = F.when(F.col("node") == n, F.col(dims[i])).otherwise(value)
        keyed = pts.withColumn("key", F.shiftleft(value, 24) + F.col("hash"))
        prefix, before = dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0)
        for k in range(ROUNDS):
            low = BITS * (ROUNDS - 1 - k)
            here = keyed.filter(F.shiftright("key", low + BITS) == lookup(F.col("node"), prefix, -1)) if k else keyed.filter(F.col("node").isin(list(open_nodes)))
            sums: dict[int, list] = {n: [] for n in open_nodes}
            for r in here.groupBy("node", F.shiftright("key", low).alias("top")).agg(F.sum("bytes").alias("bytes")).collect():
                if r["node"] in sums:
                    sums[r["node"]].append((r["top"], r["bytes"]))
            for n, found in sums.items():
                now = before[n]
                for top, w in sorted(found):
                    if now + w >= aim[n] or top == max(found)[0]:
                        prefix[n], before[n] = top, now
                        if k == ROUNDS - 1 and now + w - aim[n] > aim[n] - now:
                            prefix[n] = top - 1  # the group at the cut is nearer to the right side
                        break
                    now += w
        goes_right = F.col("node").isin(list(open_nodes)) & (F.col("key") > lookup(F.col("node"), prefix, 0))
        step = F.when(F.col("node").isin(list(open_nodes)), F.col("node") * 2 + 1 + goes_right.cast("int")).otherwise(F.col("node"))
        pts = cut(keyed.withColumn("node", step).drop("key"))
        for n, (a, b) in open_nodes.items():
            del nodes[n]
            nodes |= {2 * n + 1: (a, (a + b) // 2), 2 * n + 2: ((a + b) // 2, b)}
    return pts.withColumn("shard", lookup(F.col("node"), {n: a for n, (a, _) in nodes.items()}, 0))


def sharded(docs: DataFrame, shards: int = SHARDS, metadata: tuple[str, ...] = ("n_chars", "source", "lang"), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) and the kept columns, for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), *dict.fromkeys([*metadata, *keep]))
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole = rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > F.lit(total / shards)).select("k1", "k2", F.ceil(F.col("bytes") / F.lit(max(total, 1) / shards / 4)).alias("parts"))
    parts = {(g["k1"], g["k2"]): g["parts"] for g in whole.collect()}  # fewer than `shards` groups have so many bytes
    of = F.lit(0)
    for (k1, k2), n in parts.items():
        of = F.when((F.col("k1") == k1) & (F.col("k2") == k2), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(n)).cast("int")).otherwise(of)
    rows = rows.withColumn("part", of)
    pts = cut(points(rows, list(metadata)))
    dealt, room = heavy_groups(pts, total, shards)
    key = F.concat_ws(":", "k1", "k2", "part")
    by_hand = lookup(key, {f"{a}:{b}:{c}": s for (a, b, c), s in dealt.items()}, -1)
    pts = pts.withColumn("by_hand", by_hand)
    placed = tree(pts.filter("by_hand < 0").drop("by_hand"), room).select("k1", "k2", "part", "shard").union(pts.filter("by_hand >= 0").select("k1", "k2", "part", F.col("by_hand").alias("shard")))
    rows = cut(rows.join(placed, ["k1", "k2", "part"]).withColumn("pile", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(max(1, rows.count() // (ROWS * shards))))))
    earlier = Window.partitionBy("shard").orderBy("pile").rowsBetween(Window.unboundedPreceding, -1)
    piles = rows.groupBy("shard", "pile").agg(F.count("*").alias("n")).select("shard", "pile", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "pile").orderBy("doc_id", "k1", "k2"))
    out = rows.withColumn("inside", inside).join(piles, ["shard", "pile"]).withColumn("slot", (F.col("base") + F.col("inside") - 1).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", *keep)
