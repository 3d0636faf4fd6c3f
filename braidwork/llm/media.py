"""Media columns: chroma fingerprints of audio, found and aligned by bit errors at every offset."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import materialize
from .words import pieces

RATE = 4000
FRAME, HOP = 512, 128
SPAN = 8
ERRORS = 0.2
OVERLAP = 24
BLOCK = 2048
PAD, CELLS, KEPT = 64, 1 << 17, 1 << 26
#: The fingerprint of a span without energy: every difference is nought.
SILENT = np.uint32(0x55555555)


def decode(data: bytes | None) -> np.ndarray:
    """Mono samples in -1..1 at RATE from a PCM WAV file; null, empty or unreadable data: no samples."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width not in (1, 2, 4) or not rate:
        return np.zeros(0)
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def _pitch_classes() -> np.ndarray:
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if 60 <= f <= 1900:
            p = 12 * np.log2(f / 440.0)
            low = int(np.floor(p))
            out[i, low % 12] += 1 - (p - low)
            out[i, (low + 1) % 12] += p - low
    return out


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of unit length (silence: zeros)."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames, classes = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], _pitch_classes()
    c = np.concatenate([np.abs(np.fft.rfft(frames[i : i + BLOCK] * np.hanning(FRAME))) ** 2 @ classes for i in range(0, len(frames), BLOCK)])
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-12), 0)


#: Sixteen filters over a span of frames and a band of pitch classes: later less earlier half, upper less lower half,
#: middle less ends; each is quantised to two bits.
FILTERS = [(kind, low, high, wide) for kind in ("time", "pitch", "centre") for low, high in ((0, 12), (0, 6), (6, 12), (3, 9)) for wide in (SPAN,)] + [("time", 4 * i - 4 + i // 4, 4 * i + i // 4, SPAN // 2) for i in (1, 2, 3)] + [("pitch", 2, 10, SPAN // 2)]


def fingerprint(c: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each frame that has SPAN frames from it on."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(c) + 1, 13))
    total[1:, 1:] = c.cumsum(0).cumsum(1)
    at = np.arange(n)
    area = lambda x0, x1, y0, y1: total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]
    out = np.zeros(n, np.uint32)
    for i, (kind, low, high, wide) in enumerate(FILTERS):
        half, third = wide // 2, max(1, wide // 4)
        if kind == "time":
            a, b = area(half, wide, low, high), area(0, half, low, high)
        elif kind == "pitch":
            mid = (low + high) // 2
            a, b = area(0, wide, mid, high), area(0, wide, low, mid)
        else:
            a, b = area(third, wide - third, low, high), area(0, third, low, high) + area(wide - third, wide, low, high)
        v = np.log1p(a) - np.log1p(b)
        level = (v > -0.25).astype(np.uint32) + (v > 0) + (v > 0.25)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)  # neighbouring levels differ in one bit
    return out


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """(key, n_frames, prints): prints is the fingerprint as packed little-endian integers. One scan, no shuffle."""

    def scan(batches):
        for batch in pieces(batches, 1):
            prints = [fingerprint(chroma(decode(x))).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 4 for p in prints], pa.int64()), pa.array(prints, pa.binary())], names=[key, "n_frames", "prints"])

    return media.select(F.col(key).cast("long").alias(key), F.col(audio)).mapInArrow(scan, f"{key} long, n_frames long, prints binary")


class _Queries:
    """The fingerprints of a block of queries, the last frame first, in stacks of like lengths."""

    def __init__(self, ids: list[int], prints: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.prints = [np.frombuffer(p, "<u4") for p in prints]
        like: dict[int, list[int]] = {}
        for q, p in enumerate(self.prints):
            if len(p):
                like.setdefault(-(-len(p) // PAD), []).append(q)
        self.stacks = []
        for qs in like.values():
            n = np.array([len(self.prints[q]) for q in qs])
            stack = np.zeros((len(qs), n.max()), np.uint32)
            for row, q in zip(stack, qs, strict=True):
                row[: len(self.prints[q])] = self.prints[q][::-1]
            self.stacks.append((np.array(qs), n, stack))
        self.spectra: dict[tuple, np.ndarray] = {}

    def _spectrum(self, key: int, at: int, step: int, size: int) -> np.ndarray:
        """Frequencies by queries by bits, bits as -1 and 1; kept while they are small."""
        if (key, at, size) not in self.spectra:
            if sum(x.nbytes for x in self.spectra.values()) > KEPT:
                self.spectra.clear()
            _, n, stack = self.stacks[key]
            signs = _signs(stack[at : at + step]) * (np.arange(stack.shape[1]) < n[at : at + step, None])[:, :, None]
            self.spectra[key, at, size] = np.ascontiguousarray(np.fft.rfft(signs, size, axis=1).transpose(1, 0, 2))
        return self.spectra[key, at, size]

    def match(self, recordings: list[np.ndarray]) -> list[list[tuple[int, int, float]]]:
        """For each recording (query, offset, bit error rate) of every query that aligns with it: of all offsets with enough
        overlap, the one with the fewest wrong bits a frame (of equals the longest overlap, then the smallest), if that is
        within ERRORS. Frames that are silent in both count neither as overlap nor as equal. Correlation of the bits finds
        the pairs that can be, with room for rounding; they are then counted."""
        out: list[list] = [[] for _ in recordings]
        like: dict[int, list[int]] = {}
        for r, p in enumerate(recordings):
            if len(p):
                like.setdefault(len(p), []).append(r)
        for n, rs in like.items():
            for key, (qs, lengths, stack) in enumerate(self.stacks):
                width = n + stack.shape[1] - 1
                size = next(k << e for e in range(60) for k in (8, 9, 10, 12, 15) if k << e >= width)
                step, group = max(1, CELLS // size), max(1, CELLS * 8 // (size * min(len(qs), max(1, CELLS // size))))
                for at in range(0, len(qs), step):
                    own = lengths[at : at + step]
                    spectrum, (_, overlap, fits) = self._spectrum(key, at, step, size), _overlaps(n, own, width)
                    least = np.where(fits, 32 * overlap * (1 - 2 * ERRORS) - 0.5 - 1e-5 * 32 * overlap, np.inf).T[:, :, None].astype(np.float32)
                    still = (stack[at : at + step] == SILENT) & (np.arange(stack.shape[1]) < own[:, None])
                    still = np.fft.rfft(still.astype(np.float32), size, axis=1) if still.any() else None
                    for g in range(0, len(rs), group):
                        some = rs[g : g + group]
                        heard = np.fft.rfft(_signs(np.stack([recordings[r] for r in some])), size, axis=1).transpose(1, 2, 0)
                        agree = np.fft.irfft(spectrum @ heard, size, axis=0)[:width]
                        quiet = np.stack([recordings[r] for r in some]) == SILENT
                        if still is not None and quiet.any():
                            hush = np.fft.rfft(quiet.astype(np.float32), size, axis=1)
                            both = np.round(np.fft.irfft(still[:, None] * hush[None], size, axis=2)).transpose(2, 0, 1)[:width]
                            # 32 bits agree in a frame silent in both, of which the share (1 - 2 * ERRORS) was asked for.
                            enough = agree - 32 * 2 * ERRORS * both >= least
                            enough &= overlap.T[:, :, None] - both >= np.minimum(OVERLAP, np.minimum(n, own))[None, :, None]
                        else:
                            enough = agree >= least
                        for k, r in np.argwhere(enough.any(0)):
                            out[some[r]] += self._count(int(qs[at + k]), recordings[some[r]])
        return out

    def _count(self, q: int, prints: np.ndarray) -> list[tuple[int, int, float]]:
        own, n = self.prints[q][::-1], len(prints)
        wrong = np.zeros(n + len(own) - 1, np.int64)  # place i + (last - j): frame i on the query's frame j
        quiet, still = np.zeros(n + len(own) - 1, np.int64), own == SILENT
        for i in range(n):
            wrong[i : i + len(own)] += np.bitwise_count(own ^ prints[i])
            if prints[i] == SILENT:
                quiet[i : i + len(own)] += still
        offset, overlap, fits = (x.ravel() for x in _overlaps(n, np.array([len(own)]), len(wrong)))
        overlap = overlap - quiet
        fits &= overlap >= min(OVERLAP, n, len(own))
        rate = np.where(fits, wrong / (32 * np.maximum(overlap, 1)), 2.0)
        best = np.flatnonzero(rate == rate.min())
        best = best[np.argmax(overlap[best])]
        return [(int(self.ids[q]), int(offset[best]), float(rate[best]))] if rate[best] <= ERRORS else []


def _signs(prints: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u4").view(np.uint8).reshape(*prints.shape, 4), axis=2)
    return bits.astype(np.float32) * 2 - 1


def _overlaps(n: int, own: np.ndarray, width: int):
    """Offsets, overlaps and whether they are long enough, for queries of `own` frames by places."""
    own = own[:, None]
    offset = np.arange(width) - (own - 1)
    overlap = np.minimum(n, offset + own) - np.maximum(0, offset)
    return offset, overlap, (overlap > 0) & (overlap >= np.minimum(OVERLAP, np.minimum(n, own)))


def align(prints: DataFrame, key: str, every: int = 50) -> DataFrame:
    """One row for each recording: (key, n_frames, class_id, n_matches, matches).

    Recordings with the same fingerprint are one class, named by the smallest key. Queries are the classes of all
    recordings whose key is divisible by `every`; they are searched, in blocks of a fixed size and at every offset, against
    one recording of every class (work grows with queries times classes), and each recording gets its class's matches: the query classes other than its own, as
    query:offset:errors with the bit errors in thousandths, by query. Copies are never expanded into pairs.
    Audio that is null, unreadable or shorter than a span has no fingerprint: recordings without frames are a class each
    and match nothing. Silence matches nothing but what has the same fingerprint, and silent stretches add nothing to a
    match. Repeated keys: each row gets the result of its own recording. Empty table: no rows. Very long recordings are
    read in blocks of frames. Null keys: not queries, and null as a class name.
    """
    spark = prints.sparkSession
    own = F.when(F.col("n_frames") == 0, F.concat(F.lit("none"), F.coalesce(F.col(key).cast("string"), F.lit("")))).otherwise(F.sha2("prints", 256))
    rows = materialize(prints.withColumn("print", own), "prints")
    classes = rows.groupBy("print").agg(F.min(key).alias("class_id"), F.max("n_frames").alias("n"), F.max(F.coalesce(F.col(key) % every == 0, F.lit(False))).alias("asked"), F.first("prints").alias("prints"))
    classes = materialize(classes, "classes")
    schema = "print string, query long, shift long, errors double"
    found = None
    asked = classes.where("asked AND n > 0").select("class_id", "prints").orderBy("class_id")
    block: list = []

    def search(held):
        shared = spark.sparkContext.broadcast(held)

        def scan(batches):
            queries = _Queries(*shared.value)
            for batch in pieces(batches, 2):
                prints, own, heard = (batch.column(i).to_pylist() for i in range(3))
                out = [(p, q, o, e) for p, c, found in zip(prints, own, queries.match([np.frombuffer(x, "<u4") for x in heard]), strict=True) for q, o, e in found if q != c]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["print", "query", "shift", "errors"])

        return classes.where("n > 0").select("print", "class_id", "prints").mapInArrow(scan, schema)

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            part = search(([r[0] for r in block], [r[1] for r in block]))
            found, block = part if found is None else found.unionAll(part), []
    if block or found is None:
        part = search(([r[0] for r in block], [r[1] for r in block]))
        found = part if found is None else found.unionAll(part)
    said = F.concat_ws(":", "query", "shift", F.round(F.col("errors") * 1000).cast("int"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("query", said.alias("s")))), lambda x: x["s"]), " ")
    matches = materialize(found.groupBy("print").agg(F.count("*").alias("n_matches"), listed.alias("matches")), "matches")
    named = materialize(classes.select("print", "class_id").join(matches, "print", "left"), "named")
    return rows.join(named, "print").select(key, "n_frames", "class_id", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.coalesce("matches", F.lit("")).alias("matches"))


def render(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", note: int = 640) -> DataFrame:
    """(key, audio): each vector played as a WAV recording, a chord of two notes for each four coordinates. The tables at
    hand hold no audio; this gives the operator a media column whose likenesses are known. Null vectors: null audio."""

    def play(batches):
        t = np.arange(note) / RATE
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                if not v:
                    out.append(None)
                    continue
                x = np.nan_to_num(np.array([0.0 if y is None else y for y in v]))
                x = np.r_[x, np.zeros(-len(x) % 4)].reshape(-1, 4)
                step = np.round(np.clip((x[:, 0] + x[:, 1]) * 20, -12, 12)), np.round(np.clip((x[:, 2] + x[:, 3]) * 20, -12, 12))
                sound = sum(np.sin(2 * np.pi * (f * 2 ** (s / 12))[:, None] * t) for f, s in zip((330.0, 523.0), step, strict=True)).ravel()
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes((sound * 12000).astype("<i2").tobytes())
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "audio"])

    return vectors.select(F.col(key).cast("long").alias(key), F.col(vector)).mapInArrow(play, f"{key} long, audio binary")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = render(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return align(fingerprints(audio, "vec_id", "audio"), "vec_id")
