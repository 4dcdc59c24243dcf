"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most CAPACITY; only longer documents are cut, the first piece being the short one.
As sequences differ only by the lengths in them, the plan is made on the number of pieces of each length, at most
CAPACITY numbers whatever the input, and it stays small: a slot of a group of equal sequences is one run.

Reduction: from the longest length down, let j be a length, k the longest that fits beside it. {j, k} dominates every
set with j, and is fixed for as many pieces as there are, if it fills the sequence, if no second piece fits beside j and
any other, or if no three others fit and k is at least the largest sum of two that fit. If k is that sum's larger part
and no three others fit, {j, a, b} is fixed where it fills the sequence. A length beside which nothing fits is fixed
alone. What is left is packed best-fit decreasing, a length at a time, on groups of sequences with equal room.

The pieces then need only their rank among the pieces of their length. Ranks are found in two levels, (length, hash bucket)
and the buckets' counts, so a length that a third of all pieces has is no hot task. The plan goes to the executors with the
tasks; its size is bounded by the number of lengths.

Token ids: tiktoken with the vocabulary's ranks, a word at a time through a bounded dictionary. Tests hold them against
the `tokenizers` library as it is. A null text is empty and has the end token alone. Repeated rows are packed like any others.
"""

from __future__ import annotations

import base64
import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

CAPACITY, END = 1024, 2
ROWS = 4096


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, others from 256 on."""
    # Fixed values of the vocabulary's format: the ranges of printable bytes.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class OddSpace(Exception):
    """A part of a text is no single word, so the text can't be taken a word at a time."""


def plain(part: str) -> bool:
    """One word, with no white space of any kind in it."""
    return part.split() == [part]


class Words(dict):
    """Little-endian ids of words with the space or line end before them; forgets all when it holds too many."""

    def __init__(self, path: str, special: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, added = byte_letters(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()} if special else {}
        # Fixed value of the vocabulary's format: what its pre-tokenizer takes for a word.
        self.pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("words", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if not plain(word.removeprefix("\n")):
            raise OddSpace
        if len(self) > 400_000:
            self.clear()
        ids = self[word] = array("I", self.encode(word if word[:1] == "\n" else " " + word)).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a text; an added token in it is its own id if this was asked for, and ordinary text otherwise."""
        if any(t in text for t in self.added):
            parts = re.split("(" + "|".join(map(re.escape, self.added)) + ")", text)
            return b"".join(self.added[p] if p in self.added else self.plain_ids(p) for p in parts if p)
        return self.plain_ids(text)

    def plain_ids(self, text: str) -> bytes:
        """A single space or line end before a word is always part of its first token, so such words can't affect each other."""
        head, *rest = text.replace("\n", " \n").split(" ")
        if plain(head):
            try:
                return array("I", self.encode(head)).tobytes() + b"".join(map(self.__getitem__, rest))
            except OddSpace:
                pass
        return array("I", self.encode(text)).tobytes()  # other white space, or several in a row


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, for each piece of each row."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tail = array("I", [end]).tobytes()
    kept: list[Words] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Words(path, special))
        words = kept[0]
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (words.ids(text) if text else b"") + tail
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(itertools.pairwise(edges)):
                    for column, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs (length, first rank, number, first sequence, offset): piece first + i of the length is at the offset of sequence + i."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.capacity, self.runs, self.sequences, self.fixed = capacity, [], 0, 0
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def put(self, lengths: list[int], times: int) -> None:
        """times new sequences of these pieces."""
        offset = 0
        for n in lengths:
            self.take(n, times, self.sequences, offset)
            offset += n
        self.sequences += times

    def take(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], times, sequence, offset))
        self.rank[length] += times
        self.left[length] -= times
        if not self.left[length]:
            del self.left[length]

    def smallest(self, j: int, most: int) -> list[int]:
        """The most smallest pieces but for one of length j."""
        out: list[int] = []
        for n in sorted(self.left):
            out += [n] * min(self.left[n] - (n == j), most - len(out))
            if len(out) >= most:
                break
        return out

    def longest(self, j: int, room: int) -> int | None:
        return max((n for n, c in self.left.items() if n <= room and c > (n == j)), default=None)

    def best_two(self, j: int, room: int) -> tuple[int, int] | None:
        best = None
        for a in sorted(self.left, reverse=True):
            if a > room or self.left[a] <= (a == j):
                continue
            for b in sorted((n for n in self.left if n <= min(a, room - a)), reverse=True):
                if self.left[b] > (b == j) + (b == a) and (best is None or a + b > sum(best)):
                    best = (a, b)
                    break
        return best

    def reduce(self) -> None:
        for j in sorted(self.left, reverse=True):
            while j in self.left:
                room = self.capacity - j
                k = self.longest(j, room)
                if k is None:
                    self.put([j], self.left[j])
                    break
                three = self.smallest(j, 3)
                fill, pair = j + k == self.capacity, len(three) < 2 or sum(three[:2]) > room
                two = None
                if not (fill or pair):
                    if len(three) == 3 and sum(three) <= room:
                        break  # sets of four and more are possible; nothing dominates them
                    two = self.best_two(j, room)
                if fill or pair or two is None or k >= sum(two):
                    chosen = [j, k]
                elif sum(two) == room:
                    chosen = [j, *two]
                else:
                    break
                # until a length runs out; a condition that rests on the smallest pieces only gets stronger as they go
                self.put(chosen, min(self.left[n] // chosen.count(n) for n in set(chosen)))

    def best_fit(self) -> None:
        open_groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number)
        for n in sorted(self.left, reverse=True):
            while n in self.left:
                room = min((r for r in open_groups if r >= n), default=None)
                if room is None:
                    times = -(-self.left[n] // (self.capacity // n))
                    first, self.sequences = self.sequences, self.sequences + times
                    room = self.capacity
                    open_groups[room] = [(first, times)]
                first, times = open_groups[room].pop()
                done = min(times, self.left[n])
                self.take(n, done, first, self.capacity - room)
                if done < times:
                    open_groups[room].append((first + done, times - done))
                if not open_groups[room]:
                    del open_groups[room]
                if room > n:
                    open_groups.setdefault(room - n, []).append((first, done))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, for each piece.

    special: an added token of the vocabulary in a text is its own id, as `tokenizers` has it; by default a corpus's text can't
    write control tokens.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = cut(pieces(docs, path or vocabulary(), capacity, end, special))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sorted(Plan(counts, capacity).runs)
    table = np.array(runs, np.int64).reshape(-1, 5)
    key = table[:, 0] << 48 | table[:, 1]
    n_buckets = max(1, sum(counts.values()) // ROWS)
    order = ("doc_id", "piece", "ids_crc32", "start")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = rows.withColumn("inside", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)))
    ranked = ranked.join(bases, ["length", "bucket"]).select(*names, (F.col("base") + F.col("inside") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
