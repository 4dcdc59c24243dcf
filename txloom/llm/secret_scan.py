"""Secret scans with an incremental blob ledger.

A blob is a text, known by its SHA-256. The ledger has a row for each blob and rule version that was scanned, with
the spans found. A scan drops the blobs that the ledger has under the rules' version (an anti-join on digests alone),
scans the others, appends them, and joins the findings back to every path (doc_id), so copies and old versions of a
document share one scan. Redaction takes its spans from the ledger.

Rules: three base kinds, whose spans always stay, and kinds that the method adds (EXTRA). Per kind, matches are
leftmost and do not overlap; matches that are too short are dropped afterwards. Spans are in code points, the end
exclusive, in order of start, then of kind as KINDS lists them.

A null text is the empty text and has no spans. Texts of any length are scanned whole. Repeated rows stay repeated,
with equal findings. Other columns are kept apart by name and never clash. An empty table gives an empty ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts

# The base rules.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
BASE = ("assign", "access", "hex")
#: What the method adds: formats that prose doesn't have.
EXTRA = {
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "url": r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{6,128}@",
}
KINDS = (*BASE, *EXTRA)
VERSION = "2"
SPANS = "array<struct<kind:string,start:long,end:long>>"

#: bytes patterns fold no letters but ASCII ones. A run that is long enough starts where the run of any length does.
FIND_ASSIGN = re.compile(ASSIGN.encode(), re.IGNORECASE)
FIND = {"access": re.compile(rb"AKIA[A-Z0-9]{16,}"), "hex": re.compile(rb"[0-9a-f]{24,}"), **{k: re.compile(p.encode()) for k, p in EXTRA.items()}}
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: A literal that each match has; the search for a literal is much faster than the pattern's.
LITERAL = {"access": b"AKIA", "pem": b"-----BEGIN ", "jwt": b"eyJ", "url": b"://"}
GROUP_2 = re.compile(rb"[A-Za-z0-9+/_.=-]")


def spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        # `letters there in either case` speaks of the keyword; the value's class has both cases anyway
        found += [("assign", m.start(), m.end()) for m in FIND_ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    for kind, pattern in FIND.items():
        if kind not in LITERAL or LITERAL[kind] in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def in_code_points(text: bytes, found: list[tuple[str, int, int]]) -> list[dict]:
    if text.isascii():
        return [{"kind": k, "start": a, "end": b} for k, a, b in found]
    out, at, points = [], 0, 0
    for kind, a, b in found:  # in order of start, so each byte before the last start is decoded once
        points += len(text[at:a].decode())
        at = a
        out.append({"kind": kind, "start": points, "end": points + len(text[a:b].decode())})
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, blob (SHA-256), spans of each blob where a task meets it first (else null)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            blobs, found = [], []
            for text in texts(batch.column("text")):
                blob = hashlib.sha256(text).digest()
                blobs.append(blob.hex())
                found.append(None if blob in seen else in_code_points(text, spans(text)))
                if len(seen) > 500_000:  # bounded memory; a blob may then be scanned again, with the same result
                    seen.clear()
                seen.add(blob)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs), pa.array(found, kind)], ["doc_id", "blob", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, blob string, spans {SPANS}")


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings: doc_id, blob, spans for each row of docs; the ledger with the new blobs: blob, version, spans).

    ledger: what an earlier scan returned; its rows of other versions stay and don't count as seen. Without one, blobs are
    named and scanned in one pass, and a task that meets a blob again doesn't scan it again. With one, blobs are named first;
    texts are read for a scan only if some blob is new under the version, and each new blob is scanned in one task.
    """
    if ledger is None:
        paths = cut(scanned(docs))
        new = cut(fresh(paths, version))
    else:
        blob = F.sha2(F.coalesce("text", F.lit("")), 256)
        paths = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob.alias("blob")))
        seen = ledger.filter(F.col("version") == version).select("blob")
        unseen = cut(paths.select("blob").distinct().join(seen, "blob", "left_anti"))
        new = ledger
        if not unseen.isEmpty():
            once = docs.select("text", blob.alias("blob")).join(unseen, "blob", "left_semi").dropDuplicates(["blob"])
            new = cut(ledger.unionByName(fresh(scanned(once.select(F.lit(None).cast("long").alias("doc_id"), "text")), version)))
    hits = new.filter((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.select("doc_id", "blob").join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), new


def fresh(found: DataFrame, version: str) -> DataFrame:
    """Ledger rows of what scanned() found."""
    return found.filter("spans is not null").groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(version).alias("version"), "spans")


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(findings: DataFrame) -> DataFrame:
    """The counts and joined forms of findings."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def without(text: str, found: list[dict]) -> str:
    """The text with each span replaced by `[SECRET]` (overlapping spans: by one)."""
    out, at = [], 0
    for s in found:
        if s["start"] >= at:
            out += [text[at : s["start"]], "[SECRET]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: DataFrame, version: str = VERSION) -> DataFrame:
    """The columns of docs; each span that the ledger has for a text's blob is replaced by `[SECRET]`.

    Nothing is scanned. A text whose blob the ledger hasn't stays as it is, as does a null. Other columns are kept.
    """
    columns = docs.columns
    hits = ledger.filter((F.col("version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    rows = docs.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(hits, "_blob", "left").select(*columns, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out, found = batch.column("text").to_pylist(), batch.column("_spans").to_pylist()
            for i, some in enumerate(found):
                if some:
                    out[i] = without(out[i], some)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return rows.mapInArrow(run, docs.schema)
