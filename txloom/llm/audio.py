"""Audio features of media columns.

A payload of 8-bit samples is stored as a WAV file (lossless) and read back. Its samples are resampled by a polyphase
filter (a windowed sinc, computed only at the samples that stay), cut into overlapped frames, and turned into log-mel
filterbank energies. Frames form windows of a fixed shape (FRAMES x MELS, the last one padded with the floor), each with
its time span. Segments of sound come from frame energies with hysteresis: a segment begins above the upper level and
goes on until the energy falls below the lower one.

featured() has all of it for each row; Spark's arrays carry a window's values by frame. tensors() gives the column of
windows() as Arrow's fixed-shape tensors. digests() derives short columns from featured().

A null or empty text is a payload of 64 zero bytes. Sound is resampled and framed AT_A_TIME frames at a time, so next to a
row's own payload, stored form and features (about 4 bytes a byte of text) memory is bounded. Repeated rows stay repeated,
and equal texts give equal values, as each text is computed by itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

PAD, RATE, TARGET = 64, 16_000, 8_000
TAPS, FRAME, HOP, MELS, FRAMES = 16, 256, 128, 20, 32
FLOOR = -12.0
#: Levels over the text's least frame energy, in natural log, at which a segment ends and begins.
LOWER, UPPER = 0.6, 1.2
#: Outputs that are computed at a time, and frames.
BLOCK, AT_A_TIME = 1 << 15, 2048


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def stored(data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setparams((1, 1, rate, len(data), "NONE", ""))
            w.writeframes(data)
        return f.getvalue()


def read(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes()), w.getframerate()


def kernel(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A Hann-windowed sinc for the rate of input times up, with unit gain after zero stuffing."""
    widest = max(up, down)
    t = np.arange(-taps * widest // 2, taps * widest // 2 + 1)
    h = np.sinc(t / widest) / widest * np.hanning(len(t) + 2)[1:-1]
    return (h / h.sum() * up).astype(np.float32)


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling: output k is the filter's phase k * down % up against the inputs around k * down / up."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    h = kernel(up, down)
    half = len(h) // 2
    n = -(-len(x) * up // down)
    span = half // up + 1
    padded = np.concatenate((np.zeros(span, np.float32), x, np.zeros(span + down + 1, np.float32)))
    out = np.empty(n, np.float32)
    taps = np.arange(-span, span + 1)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * span + 1)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        at = half + first * down % up - taps * up
        phase = np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0).astype(np.float32)
        own = windows[first * down // up :: down][: len(range(first, n, up))]
        for a in range(0, len(own), BLOCK):
            out[first + a * up : first + (a + BLOCK) * up : up] = own[a : a + BLOCK] @ phase
    return out


def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles that are even on the mel scale; rows: bins of the spectrum."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(20), to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    up = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


BANK = mel_bank(TARGET)
HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and log energies of the frames."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate((x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, 2048):
        part = frames[a : a + 2048]
        spectrum = np.fft.rfft(part * HANN)
        power = spectrum.real**2 + spectrum.imag**2
        mel[a : a + 2048] = np.maximum(np.log(power @ BANK + 1e-12), FLOOR)
        energy[a : a + 2048] = np.log((part * part).mean(1) + 1e-6)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds where the energy went above the upper level and stayed above the lower."""
    base = energy.min()
    out, start = [], None
    above, below = (energy - base >= UPPER), (energy - base < LOWER)
    at = np.flatnonzero(above | below)
    for i in at.tolist():
        if start is None and above[i]:
            start = i
        elif start is not None and below[i]:
            out.append((start * HOP / TARGET, i * HOP / TARGET))
            start = None
    if start is not None:
        out.append((start * HOP / TARGET, ((len(energy) - 1) * HOP + FRAME) / TARGET))
    return out


def sound(data: bytes, rate: int, start: int, stop: int) -> np.ndarray:
    """Samples start to stop of the resampled payload, from the bytes around them; zeros beyond its end."""
    g = gcd(rate, TARGET)
    up, down = TARGET // g, rate // g
    margin = (TAPS + 2) * max(up, down)
    first = max(0, start // up * down - margin * down)  # a multiple of down, so outputs keep their phases
    last = min(len(data), -(-stop // up) * down + margin * down)
    x = (np.frombuffer(data, np.uint8, last - first, first).astype(np.float32) - 128) / 128
    lead = first // down * up
    y = resampled(x, rate, TARGET)[start - lead : min(stop, -(-len(data) * up // down)) - lead]
    return np.concatenate((y, np.zeros(stop - start - len(y), np.float32)))


def analysed(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float]]]:
    """What was read back, its log-mel energies, its segments."""
    data, rate = read(media)
    n = -(-len(data) * TARGET // rate)
    frames = 1 + max(0, -(-(n - FRAME) // HOP))
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, AT_A_TIME):
        b = min(frames, a + AT_A_TIME)
        mel[a:b], energy[a:b] = log_mel(sound(data, rate, a * HOP, (b - 1) * HOP + FRAME))
    return data, mel, segments(energy)


def windowed(mel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in seconds, and values (windows x FRAMES x MELS; the last window is filled up with the floor)."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * FRAMES * HOP / TARGET
    end = ((np.minimum(np.arange(1, n + 1) * FRAMES, len(mel)) - 1) * HOP + FRAME) / TARGET
    return start, end, full.reshape(n, FRAMES, MELS)


def summary(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """frames:segments:seconds of sound:mean and deviation of each mel band, as bytes in hex."""
    levels = np.concatenate((mel.mean(0), mel.std(0))) * 8
    quantised = np.clip(np.round(levels), -128, 127).astype(np.int8).tobytes().hex()
    return f"{len(mel)}:{len(spans)}:{sum(b - a for a, b in spans):.3f}:{quantised}"


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
TENSOR = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.list_(pa.float32()))])
KINDS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "summary": pa.string(), "segments": pa.list_(SPAN),
}
FEATURED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, summary string, "
    "segments array<struct<start_s:double,end_s:double>>, windows array<struct<start_s:double,end_s:double,log_mel:array<float>>>"
)


def structs(starts: np.ndarray, ends: np.ndarray, tensors: np.ndarray, counts: list[int]) -> pa.Array:
    """The windows of several rows: lists of (start, end, values)."""
    n = len(starts)
    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * FRAMES * MELS, pa.int32()), pa.array(tensors.ravel()))
    each = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), values], fields=list(TENSOR))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), each)


def featured(docs: DataFrame) -> DataFrame:
    """For each row: its payload and stored form by length and digest, its segments, its windows (time span and log-mel tensor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in KINDS]
            windows: list[tuple] = []
            for text in texts(batch.column("text")):
                media = stored(payload(text))
                data, mel, spans = analysed(media)
                row = (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary(mel, spans), [{"start_s": a, "end_s": b} for a, b in spans])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
                windows.append(windowed(mel))
            if windows:
                listed = structs(*(np.concatenate(x) for x in zip(*windows, strict=True)), [len(w[0]) for w in windows])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, KINDS.values(), strict=True)), listed], ["doc_id", *KINDS, "windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURED)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, for each row.

    feature: the summary, the number of windows, and a hash of all windows' and segments' time spans and values.
    """
    of_all = F.lpad(F.lower(F.hex(F.xxhash64("windows", "segments"))), 16, "0")
    feature = F.concat_ws(":", "summary", F.size("windows").cast("string"), of_all)
    return featured(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, window, start_s, end_s, log_mel (FRAMES * MELS values by frame), for each window of each row's sound."""
    each = featured(docs).select("doc_id", F.posexplode("windows").alias("window", "w"))
    return each.select("doc_id", "window", "w.start_s", "w.end_s", "w.log_mel")


def tensors(table: pa.Table) -> pa.Table:
    """windows() as an Arrow table, its log_mel column as fixed-shape tensors of FRAMES x MELS."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel"))
    flat = table.column("log_mel").combine_chunks()
    storage = flat.cast(pa.list_(pa.float32(), FRAMES * MELS))
    return table.set_column(table.schema.get_field_index("log_mel"), "log_mel", pa.ExtensionArray.from_storage(kind, storage))
