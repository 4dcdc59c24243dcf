"""Quality by a weak-label model.

Overlapping heuristic labellers look at every document. Each speaks for one class: those for junk know one kind of junk
each, one speaks for good prose. Documents are counted by the pattern of labellers that spoke, of which there are at most
2 ** len(LABELLERS), so expectation-maximisation runs on these counts and sees the whole corpus. For each class it estimates
how often each labeller speaks (so silence counts for what it is worth), from these the share of junk and each labeller's
accuracy (how often it is right when it speaks); its posterior is each document's soft label. A linear scorer over hashed
features learns the posterior on a sample of at most SAMPLE distinct texts (chosen by a hash of the text, without words:
none) and scores every document. No gold labels are used; the test holds the scorer against them.

Features: frequencies of character-class sequences of the whole text, hashed, and levels of word statistics, hashed.
A text without words (null, empty, white space) gets score 1 and is rejected; it is not trained on. Rows of equal text
have equal scores. If the corpus holds no junk by the labellers, nothing with words is rejected. Other columns stay out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts

#: Distinct texts that the scorer is trained on, at most.
SAMPLE = 4000
HASHED, LEVELS = 4096, 16
REJECT = 0.5
#: How often a labeller is thought right before the votes are seen, and what that is worth as a share of its votes.
TRUST, STRENGTH = 0.9, 0.02
#: Words of a window in which variety is measured, so that a text's length has no part in it.
WINDOW = 200

#: Character classes: space, line end, lower, upper, digit, sentence end, comma and the like, bracket or quote, other ASCII, beyond ASCII.
CLASS = np.full(256, 8, np.uint8)
CLASS[128:] = 9
for _name, _chars in enumerate((b" \t\v\f", b"\r\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:-", b"()[]'\"")):
    CLASS[list(_chars)] = _name
PLACE = np.array([xxhash.xxh32_intdigest(i.to_bytes(2, "little"), 3) % HASHED for i in range(10_000)], np.int64)
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def variety(words: list[bytes]) -> float:
    """Share of distinct words in the mean of windows over the whole text (a last, shorter one left out of several)."""
    parts = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
    if len(parts) > 1 and len(parts[-1]) < WINDOW:
        parts.pop()
    return sum(len(set(p)) / len(p) for p in parts) / len(parts)


def statistics(text: bytes) -> dict[str, float]:
    """Shares that the labellers judge by."""
    words = text.split()
    n = len(words)
    if not n:
        return {}
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = [w.strip(PUNCTUATION) for w in words]
    letters = [b for b in bare if len(b) > 1]
    tails = [w[len(w.rstrip(PUNCTUATION)) :] for w in words]
    return {
        "words": n,
        "noise": sum(len(t) > 1 and t[:2] not in (b'."', b",\"", b".)", b"..", b"?\"", b"!\"") for t in tails) / n,
        "marks": sum(not b for b in bare) / n,
        "shout": sum(b.decode().isupper() for b in letters) / max(len(letters), 1),
        "stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "variety": variety(words),
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
    }


def by_share(name: str, least: float, least_words: int = 8) -> Callable[[dict[str, float]], bool]:
    """Speaks from a share on, in texts that are not too short for it."""
    return lambda s: s["words"] >= least_words and s[name] >= least


def prose(s: dict[str, float]) -> bool:
    """Words of letters with little else, and not the same ones over and over."""
    return s["noise"] < 0.05 and s["marks"] < 0.05 and s["shout"] < 0.2 and s["stutter"] < 0.15 and s["lines"] < 0.4 and (s["words"] < 20 or s["variety"] > 0.4)


#: (class spoken for: 1 junk, 0 good; the test)
LABELLERS = [
    (1, by_share("noise", 0.15)),
    (1, by_share("marks", 0.12)),
    (1, by_share("shout", 0.4)),
    (1, by_share("stutter", 0.25)),
    (1, by_share("lines", 0.45, 20)),
    (1, lambda s: s["words"] >= 20 and s["variety"] < 0.35),
    (0, prose),
]


def pattern(s: dict[str, float]) -> int:
    """A bit for each labeller that speaks."""
    return sum(speaks(s) << k for k, (_, speaks) in enumerate(LABELLERS))


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id, pattern (null: no words), chance (a hash of the text in [0, 1))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [statistics(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pattern(s) if s else None for s in found], pa.int32())], ["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pattern int")


def estimate(counts: dict[int, int], rounds: int = 500) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of junk, accuracy of each labeller, and the posterior of each pattern.

    The start takes a document for junk if labellers for junk alone speak, and for good if the other one does alone. The belief
    that a labeller is right TRUST of the time is worth STRENGTH of its votes and one more, so it decides where there are hardly
    any. A document on which all are silent gets the share of junk.
    """
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    spoke = np.array([[c >> k & 1 for k in range(len(LABELLERS))] for c in codes], float).reshape(-1, len(LABELLERS))
    side = np.array([k for k, _ in LABELLERS])
    junk, good = spoke @ side > 0, spoke @ (1 - side) > 0
    post = np.where(junk & ~good, TRUST, np.where(good & ~junk, 1 - TRUST, 0.5))
    belief = 1 + STRENGTH * (weight @ spoke)
    for_junk = np.where(side == 1, TRUST, 1 - TRUST)
    for _ in range(rounds):
        mass = [weight @ (1 - post) + 1, weight @ post + 1]
        rates = [np.clip(((weight * p) @ spoke + belief * t) / (m + belief), 1e-6, 1 - 1e-6) for p, t, m in ((1 - post, 1 - for_junk, mass[0]), (post, for_junk, mass[1]))]
        said = spoke @ np.log(rates[1] / rates[0]) + (1 - spoke) @ np.log((1 - rates[1]) / (1 - rates[0]))
        new = 1 / (1 + np.exp(-np.clip(np.log(mass[1] / mass[0]) + said, -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    share = weight @ post / max(weight.sum(), 1)
    right = (weight * post) @ (spoke * side) + (weight * (1 - post)) @ (spoke * (1 - side))
    return float(share), (right + 0.01) / (weight @ spoke + 0.02), dict(zip(codes, np.where(spoke.any(1), post, share).tolist(), strict=True))


def features(text: bytes, s: dict[str, float] | None = None) -> np.ndarray:
    """Hashed frequencies of sequences of four character classes, then one-hot levels of each word statistic."""
    c = CLASS[np.frombuffer(text, np.uint8)].astype(np.int64)
    out = np.zeros(HASHED + 6 * LEVELS, np.float32)
    if len(c) >= 4:
        codes = np.bincount(((c[:-3] * 10 + c[1:-2]) * 10 + c[2:-1]) * 10 + c[3:], minlength=10_000)
        np.add.at(out, PLACE, codes.astype(np.float32))
        out[:HASHED] = np.sqrt(out[:HASHED] / (len(c) - 3))
    s = statistics(text) if s is None else s
    for k, name in enumerate(("noise", "marks", "shout", "stutter", "variety", "lines")):
        if s:
            out[HASHED + k * LEVELS + min(int(s[name] * LEVELS), LEVELS - 1)] = 1
    return out


def sample(docs: DataFrame, rate: float, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and vote patterns of about rate of the distinct texts, `most` at most, by a hash of each text.

    The driver gets the features that aren't zero, about a kilobyte a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # as many as one task chooses; copies in other tasks go below
        for batch in slices(batches, "text"):
            for t, place in zip(texts(batch.column("text")), batch.column("place").to_pylist(), strict=True):
                if place not in seen and (s := statistics(t)):
                    seen.add(place)
                    x = features(t, s)
                    at = np.flatnonzero(x)
                    row = [place], [at.astype(np.uint16).tobytes()], [x[at].astype(np.float16).tobytes()]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, row), pa.array([pattern(s)], pa.int32())], ["place", "at", "value", "pattern"])

    chosen = docs.select("text", F.xxhash64(F.lit(23), "text").alias("place")).filter(F.pmod("place", F.lit(1 << 20)) < F.lit(round(rate * (1 << 20))))
    found = chosen.mapInArrow(run, "place long, at binary, value binary, pattern int").dropDuplicates(["place"])
    rows = found.orderBy("place").limit(most).toArrow()
    x = np.zeros((rows.num_rows, HASHED + 6 * LEVELS), np.float32)
    for i, (at, value) in enumerate(zip(rows.column("at"), rows.column("value"), strict=True)):
        x[i, np.frombuffer(at.as_buffer(), np.uint16)] = np.frombuffer(value.as_buffer(), np.float16)
    return x, rows.column("pattern").to_numpy()


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer of soft labels, by full-batch Adam."""
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    y = y.astype(np.float32)
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y  # all in single precision, so x is never copied
        g = np.append(error @ x, error.sum()) / max(len(y), 1) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def model(docs: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """The scorer for a corpus."""
    votes = cut(patterns(docs))
    counts = {r["pattern"]: r["count"] for r in votes.filter("pattern is not null").groupBy("pattern").count().collect()}
    if not counts:
        return np.zeros(HASHED + 6 * LEVELS + 1)
    _, _, post = estimate(counts)
    x, codes = sample(docs, min(1.0, size / sum(counts.values())))
    return fit(x, np.array([post[c] for c in codes.tolist()]))


def scored(docs: DataFrame, weights: np.ndarray | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The doc_id, score (chance of junk) and kept columns of each row."""
    w = model(docs) if weights is None else weights
    columns = ["doc_id", *(c for c in dict.fromkeys(("text", *keep)) if c != "doc_id")]
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns[1:])
    shown = ["doc_id", *(c for c in keep if c != "doc_id")]
    schema = ", ".join(f"`{c}` {k}" for c, k in table.select(*shown).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = texts(batch.column("text"))
            score = [1.0 if not t.split() else float(1 / (1 + np.exp(-(features(t) @ w[:-1] + w[-1])))) for t in raw]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), pa.array(score, pa.float64())], [*shown, "score"])

    return table.mapInArrow(run, f"{schema}, score double")
