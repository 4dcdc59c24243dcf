"""Substring dedup by De Bruijn compaction.

The graph's edges are the windows of SPAN consecutive words of a document (token k-mers), its nodes the sequences of SPAN - 1
words between them. Edges that occur once can't take part in a repeat, so only repeated ones are kept:

1. Each edge is dealt to the least hashed ANCHOR-word sequence in it (its minimizer, ties to the left), which depends on the
   edge's words only. Consecutive edges of a document with the same minimizer occurrence travel as one row: at most
   SPAN - ANCHOR + 1 edges, with a hash of all their words, the row's key, start and length. Equal edges meet under their
   minimizer, so a minimizer that occurs once ends the matter for all edges under it.
2. Under a repeated minimizer, a stretch whose hash occurs twice is a unit of repeated edges. Of stretches that occur once but
   share their minimizer with others, the words are read again at their source coordinates and single edges are compared; each
   repeated one is a unit.
3. Units of a document that follow each other without a gap are joined at a node. The degree table has for each unit how many
   different units (or none) come before and after it. Where neither side branches, units are compacted to one path;
   a path is known by its first unit and its number of edges, as what follows is the same at each occurrence.
4. Each path's words are read at two of its source coordinates, and a digest of them (128 bits over the words as they stand
   there) is joined to all its occurrences. An occurrence whose own words have another digest than those at the other place is
   no repeat. The words that verified paths cover go. Words themselves stay where they are: shipped to all occurrences
   they took more disk than the rest of the job.

Edges are found by 128 bits (minimizer and hash). A path of which one place only is known, because its other occurrences lie
inside longer stretches, rests on these alone. Rows are known by 128 bits of doc_id and text, so
copies of a text are dealt apart. No step lists the pairs of a group; what many rows share is counted by partial aggregates
and joined by joins whose sides are both exchanges, which skew handling can split. Only rows that agree in doc_id and text,
or copies without doc_id, share a key.

Nulls, empty texts and texts of fewer than SPAN words lose nothing. Repeated rows count as occurrences and stay
repeated. Texts of any length are hashed in blocks that overlap by SPAN - 1 words. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, texts, tidy

SPAN, ANCHOR = 35, 8
#: Words of a text that are hashed at a time; positions in a block must fit 24 bits.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION = np.uint64((1 << 24) - 1)
KEYS = ["k1", "k2"]


class Hashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes mod 2**64 of all runs of width words, by doubling; empty where there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out, done, power, part, size = None, 0, BASE, h, 1
    while True:
        if width & size:
            piece = part[done : done + n]
            out = piece if out is None else out * power + piece
            done += size
        if size * 2 > width:
            return out
        part, size = part[: len(part) - size] * power + part[size:], size * 2
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)


def least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of all runs of width values, by doubling."""
    n, size = len(v) - width + 1, 1
    while size * 2 <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


def edges(words: np.ndarray, ends: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For concatenated documents that end at ends: the starts of all edges, hashes of each, minimizers, minimizers' places."""
    every = rolled(words, span)
    starts = np.arange(len(every))
    starts = starts[starts + span <= ends[np.searchsorted(ends, starts, "right")]] if len(every) else starts
    short = mixed(rolled(words, anchor))
    place = (short & ~POSITION) | np.arange(len(short), dtype=np.uint64)
    place = (least(place, span - anchor + 1) & POSITION).astype(np.int64) if len(every) else starts
    return starts, mixed(every)[starts], short[place[starts]] if len(every) else short[:0], place[starts]


def pieces(words: np.ndarray, ends: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Starts, numbers of edges, minimizers and word hashes of all path pieces."""
    starts, hashed, minimizer, place = edges(words, ends, span, anchor)
    if not len(starts):
        return starts, starts, hashed, hashed
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    n = np.diff(np.concatenate((first, [len(starts)])))
    whole = mixed(hashed[first] * np.uint64(3) + mixed(hashed[first + n - 1] + n.astype(np.uint64)))
    return starts[first], n, minimizer[first], whole


def in_blocks(counts: list[int], span: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, from, to) of about BLOCK words; longer documents are cut with an overlap of span - 1."""
    group, total = [], 0
    for d, n in enumerate(counts):
        for a in range(0, max(n - span + 1, 0), BLOCK):
            b = min(n, a + BLOCK + span - 1)
            if group and total + b - a > BLOCK:
                yield group
                group, total = [], 0
            group.append((d, a, b))
            total += b - a
    if group:
        yield group


def listed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int64()))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: as empty) and a 128-bit key of both, so that copies of a text are dealt apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))


def path_pieces(keyed_docs: DataFrame, span: int, anchor: int) -> DataFrame:
    """A row for each document with edges: keys; arrays of minimizers, word hashes and coordinates (start * 64 + edges)."""
    names = [*KEYS, "minimizers", "wholes", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in slices(batches, "text"):
            words = [t.split() for t in texts(batch.column("text"))]
            counts = [len(w) for w in words]
            parts: list[list] = [[], [], [], []]
            for group in in_blocks(counts, span):
                flat = np.array([h for d, a, b in group for h in map(known.__getitem__, words[d][a:b])], np.uint64)
                lengths = np.array([b - a for _, a, b in group])
                ends = np.cumsum(lengths)
                starts, n, minimizer, whole = pieces(flat, ends, span, anchor)
                part = np.searchsorted(ends, starts, "right")
                own = np.array([d for d, _, _ in group])[part]
                local = starts - (ends - lengths)[part] + np.array([a for _, a, _ in group])[part]
                for kept, x in zip(parts, (own, minimizer.view(np.int64), whole.view(np.int64), local * 64 + n), strict=True):
                    kept.append(x)
            if not parts[0]:
                continue
            own, minimizer, whole, places = map(np.concatenate, parts)
            rows = np.unique(own)
            sizes = np.bincount(own, minlength=len(words))[rows]
            keys = [batch.column(k).take(pa.array(rows)) for k in KEYS]
            yield pa.RecordBatch.from_arrays([*keys, *(listed(x, sizes) for x in (minimizer, whole, places))], names)

    return keyed_docs.mapInArrow(run, "k1 long, k2 long, minimizers array<long>, wholes array<long>, places array<long>")


def single_edges(asked: DataFrame, columns: list[str], span: int, anchor: int) -> DataFrame:
    """The edges of the asked pieces: minimizer, edge, and its row's keys and start if the piece occurs once, else nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            columns = [texts(batch.column("text")), *(batch.column(c).to_pylist() for c in (*KEYS, "asked"))]
            for text, k1, k2, places in zip(*columns, strict=True):
                words = text.split()
                for ask in places:
                    once, start, n = ask & 1, ask >> 7, (ask >> 1) & 63
                    flat = np.array([known[w] for w in words[start : start + n + span - 1]], np.uint64)
                    _, hashed, minimizer, _ = edges(flat, np.array([len(flat)]), span, anchor)
                    out[0] += minimizer.view(np.int64).tolist()
                    out[1] += hashed.view(np.int64).tolist()
                    out[2] += [k1 if once else None] * n
                    out[3] += [k2 if once else None] * n
                    out[4] += range(start, start + n) if once else [None] * n
                if len(out[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["minimizer", "edge", *KEYS, "start"])
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["minimizer", "edge", *KEYS, "start"])

    return asked.select(*columns).mapInArrow(run, "minimizer long, edge long, k1 long, k2 long, start long")


def units(keyed_docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """k1, k2, start, n (edges), u1, u2 (identity) of each stretch of repeated edges, once for each row key and start."""
    spark = keyed_docs.sparkSession
    base = cut(path_pieces(keyed_docs, span, anchor))
    rows = base.select(*KEYS, F.explode(F.arrays_zip("minimizers", "wholes", "places")).alias("x")).select(*KEYS, F.col("x.minimizers").alias("minimizer"), F.col("x.wholes").alias("whole"), F.col("x.places").alias("place"))
    # written before the join, here and below, so that both sides of a join are exchanges and a hot key can be split
    again = cut(rows.groupBy("minimizer").agg(F.count("*").alias("n")).filter("n > 1").select("minimizer"))
    rows = cut(rows.join(again, "minimizer", "left_semi"))
    del base, again
    tidy(spark)
    pair = cut(rows.groupBy("minimizer", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "place")).alias("at")))
    paths = rows.join(pair.filter("n > 1").select("minimizer", "whole"), ["minimizer", "whole"], "left_semi")
    branching = cut(pair.groupBy("minimizer").agg(F.count("*").alias("n")).filter("n > 1").select("minimizer"))
    ask = F.col("at.place") * 2 + F.when(F.col("n") == 1, 1).otherwise(0)
    asked = pair.join(branching, "minimizer", "left_semi").select(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"), ask.alias("ask")).groupBy(*KEYS).agg(F.collect_list("ask").alias("asked"))
    columns = ["doc_id", "text", *KEYS, "asked"]
    single = cut(single_edges(keyed_docs.join(asked.hint("shuffle_hash"), KEYS).select(*columns), columns, span, anchor))
    del asked, branching
    tidy(spark)
    twice = cut(single.groupBy("minimizer", "edge").agg(F.count("*").alias("n")).filter("n > 1").select("minimizer", "edge"))
    branches = single.filter("k1 is not null").join(twice, ["minimizer", "edge"], "left_semi")
    both = paths.select(*KEYS, F.shiftright("place", 6).alias("start"), F.col("place").bitwiseAND(F.lit(63)).alias("n"), F.col("minimizer").alias("u1"), F.col("whole").alias("u2"))
    found = cut(both.union(branches.select(*KEYS, "start", F.lit(1).cast("long"), "minimizer", "edge")).dropDuplicates([*KEYS, "start"]))
    del rows, pair, paths, single, twice, branches, both
    tidy(spark)
    return found


def compacted(found: DataFrame) -> DataFrame:
    """k1, k2, start, edges, u1, u2 (the first unit): the occurrences of maximal paths without branches."""
    in_row = Window.partitionBy(*KEYS).orderBy("start")
    follows = F.lead("start").over(in_row) == F.col("start") + F.col("n")
    preceded = F.lag(F.col("start") + F.col("n")).over(in_row) == F.col("start")
    unit = F.xxhash64("u1", "u2")
    near = found.select("u1", "u2", F.when(follows, F.lead(unit).over(in_row)).alias("next"), F.when(preceded, F.lag(unit).over(in_row)).alias("last"))
    # a unit branches if it has two neighbours on a side, or one at some places and none (words that aren't repeated) at others
    ends = [f(c).alias(f"{n}_{c}") for c in ("next", "last") for f, n in ((F.min, "min"), (F.max, "max"), (F.count, "count"))]
    degrees = near.groupBy("u1", "u2").agg(F.count("*").alias("all"), *ends)
    branches = lambda c: (F.col(f"min_{c}") != F.col(f"max_{c}")) | (F.col(f"count_{c}") > 0) & (F.col(f"count_{c}") < F.col("all"))
    sides = [F.coalesce(branches(c), F.lit(False)).alias(n) for c, n in (("last", "joins"), ("next", "forks"))]
    table = cut(degrees.select("u1", "u2", *sides).filter("joins OR forks"))
    tidy(found.sparkSession)
    known = found.join(table, ["u1", "u2"], "left").select(*KEYS, "start", "n", "u1", "u2", F.coalesce("joins", F.lit(False)).alias("joins"), F.coalesce("forks", F.lit(False)).alias("forks"))
    begins = ~F.coalesce(preceded, F.lit(False)) | F.col("joins") | F.coalesce(F.lag("forks").over(in_row), F.lit(True))
    runs = known.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(in_row))
    head = F.min(F.struct("start", "u1", "u2")).alias("head")
    return runs.groupBy(*KEYS, "run").agg(head, F.sum("n").alias("edges")).select(*KEYS, "head.start", "edges", "head.u1", "head.u2")


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def digests_at(asked: DataFrame, span: int) -> DataFrame:
    """u1, u2, edges, last (which of the two places), digest of the words, for the asked places of each text."""
    names = ["u1", "u2", "edges", "last", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for text, places in zip(texts(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                words = text.split()
                for p in places:
                    row = (p["u1"], p["u2"], p["edges"], p["last"], digest_of(words[p["start"] : p["start"] + p["edges"] + span - 1]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return asked.mapInArrow(run, "u1 long, u2 long, edges long, last boolean, digest binary")


def covered(words: list[bytes], places: list[dict] | None, span: int) -> np.ndarray:
    """Which words the places cover whose words have the digest that is expected there (null: not to be compared)."""
    steps = np.zeros(len(words) + 1, np.int64)
    for p in places or ():
        a, b = p["start"], p["start"] + p["edges"] + span - 1
        if p["digest"] is None or digest_of(words[a:b]) == p["digest"]:
            steps[a] += 1
            steps[b] -= 1
    return np.cumsum(steps[:-1]) > 0


def repeated(keyed_docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """keyed_docs with places: start, edges and expected digest of the repeated paths of each row; null: none.

    An occurrence of a path is compared with the path's least place, that one with the greatest. A path with one place only is
    that of a row that is repeated as it is. The texts' exchange by key is used for the digests and for the result.
    """
    spark = keyed_docs.sparkSession
    spots = cut(compacted(units(keyed_docs, span, anchor)))
    tidy(spark)
    name = ["u1", "u2", "edges"]
    spot = F.struct(*KEYS, "start")
    of_path = cut(spots.groupBy(*name).agg(F.min(spot).alias("least"), F.max(spot).alias("greatest")).filter("least < greatest"))
    tidy(spark)
    ends = [of_path.select(F.col(f"{e}.k1").alias("k1"), F.col(f"{e}.k2").alias("k2"), F.struct(*name, F.col(f"{e}.start").alias("start"), F.lit(last).alias("last")).alias("x")) for e, last in (("least", False), ("greatest", True))]
    asked = ends[0].union(ends[1]).groupBy(*KEYS).agg(F.collect_list("x").alias("asked"))
    columns = ["doc_id", "text", *KEYS, "asked"]
    there = digests_at(keyed_docs.join(asked.hint("shuffle_hash"), KEYS).select(*columns), span)
    both = there.groupBy(*name).agg(*(F.max(F.when(F.col("last") == last, F.col("digest"))).alias(n) for n, last in (("first", False), ("other", True))))
    pairs = of_path.select(*name, "least").join(both, name)
    # a fourth key that follows from the three, so that both sides are exchanges and a path at many places can be split
    of_name = F.xxhash64(*name).alias("of_name")
    expected = spots.select("*", of_name).join(pairs.select("*", of_name), [*name, "of_name"], "left").select(*KEYS, "start", "edges", F.when(spot == F.col("least"), F.col("other")).otherwise(F.col("first")).alias("digest"))
    places = expected.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "edges", "digest")).alias("places"))
    return keyed_docs.join(places.hint("shuffle_hash"), KEYS, "left").select("doc_id", "text", *KEYS, "places")


def removed(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space), spans (of words, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, gone, digest, kept_texts, spans = [], [], [], [], []
            for text, places in zip(texts(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                words = text.split()
                out = covered(words, places, span)
                kept = [w for w, o in zip(words, out.tolist(), strict=True) if not o] if out.any() else words
                joined = b" ".join(kept)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode())
                spans.append(edge.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return repeated(keyed(docs), span, anchor).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<long>")
