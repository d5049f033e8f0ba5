"""Media columns: chroma audio fingerprints (operator 5).

A recording (WAV bytes, 16-bit PCM) becomes frames of energy in twelve pitch classes. Filters over the integral
image of those frames compare areas of time and pitch; each gives two bits in Gray code, and sixteen of them one
packed 32-bit code per frame. Two recordings are aligned by the histogram of the offsets at which they share
a code, and by the bit errors of their overlap at the best offsets.

Defined results: null, empty, broken, silent or too short recordings have no codes and align with
nothing (null offset, bit error 1); of equally good offsets the smallest in size wins, the negative one first; equal rows give
equal codes; an empty table gives no rows. Recordings are read whole, in blocks of frames.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, table

WINDOW, HOP = 1024, 256
LOWEST, HIGHEST = 110.0, 1760.0  # Hz
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
SPAN = 16  # frames a code looks at
MIN_MATCHES = 3


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate."""
    if not data:
        return np.zeros(0, np.float32), 1
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2 or f.getnchannels() < 1:
                return np.zeros(0, np.float32), 1
            raw, channels, rate = f.readframes(f.getnframes()), f.getnchannels(), f.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), 1
    samples = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
    return (samples.mean(axis=1) / 32768).astype(np.float32), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(samples: np.ndarray, rate: int, block: int = 2048) -> np.ndarray:
    """Frames x 12: smoothed energy by pitch class, each frame of unit length (zero where silent)."""
    count = (len(samples) - WINDOW) // HOP + 1
    if count < 1:
        return np.zeros((0, 12), np.float32)
    hz = np.fft.rfftfreq(WINDOW, 1 / rate)
    use = (hz >= LOWEST) & (hz <= min(HIGHEST, rate / 2))
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    to_class = np.eye(12, dtype=np.float32)[pitch]
    taper = np.hanning(WINDOW).astype(np.float32)
    views = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    energy = np.concatenate([(np.abs(np.fft.rfft(views[k : k + block] * taper)[:, use]) ** 2).astype(np.float32) @ to_class for k in range(0, count, block)])
    padded = np.pad(energy, ((2, 2), (0, 0)))
    smooth = sum(w * padded[k : k + count] for k, w in enumerate(SMOOTH))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-4, smooth / np.maximum(norm, 1e-9), 0)


def _areas():
    """Sixteen filters by rule: kind, first pitch class, height, width.

    Kinds split a box into halves by pitch, halves by time, a checkerboard, or a middle band against its flanks.
    """
    for k in range(16):
        kind = k % 4
        height = (4, 6, 4, 9)[kind]
        yield kind, (5 * k) % (12 - height + 1), height, (4, 8, 8, 16)[(k // 4 + kind) % 4]


FILTERS = list(_areas())
CUTS = (-0.12, 0.0, 0.12)  # of the log ratio of two areas
GRAY = np.array([0, 1, 3, 2], np.uint32)


def codes(frames: np.ndarray) -> np.ndarray:
    """A packed code for each frame that has SPAN - 1 frames after it."""
    n = len(frames) - SPAN + 1
    if n < 1 or not frames.any():
        return np.zeros(0, np.uint32)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(axis=0, dtype=float).cumsum(axis=1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        half, middle, third = w // 2, y + h // 2, h // 3
        if kind == 0:
            a, b = area(0, w, y, middle), area(0, w, middle, y + h)
        elif kind == 1:
            a, b = area(0, half, y, y + h), area(half, w, y, y + h)
        elif kind == 2:
            a = area(0, half, y, middle) + area(half, w, middle, y + h)
            b = area(0, half, middle, y + h) + area(half, w, y, middle)
        else:
            a, b = 2 * area(0, w, y + third, y + 2 * third), area(0, w, y, y + third) + area(0, w, y + 2 * third, y + h)
        level = np.searchsorted(CUTS, np.log((np.maximum(a, 0) + 0.05) / (np.maximum(b, 0) + 0.05)), "right")
        out = out << np.uint32(2) | GRAY[level]
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    return codes(chroma(*read_wav(data)))


def align(a: np.ndarray, b: np.ndarray, tries: int = 8) -> tuple[int | None, float, int]:
    """(offset, bit error, overlap): code k of `a` answers code k + offset of `b`.

    The `tries` fullest places of the offset histogram are compared bit by bit. Without MIN_MATCHES shared
    codes at one offset there is none.
    """
    if not len(a) or not len(b):
        return None, 1.0, 0
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    histogram = np.zeros(len(a) + len(b) - 1, np.int64)
    step = max(1, 1_000_000 // max(int((high - low).max()), 1))
    for k in range(0, len(a), step):  # blocks bound the number of pairs at once
        size = (high - low)[k : k + step]
        at = np.repeat(low[k : k + step], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        histogram += np.bincount(order[at] - np.repeat(np.arange(k, k + len(size)), size) + len(a) - 1, minlength=len(histogram))
    offsets = np.arange(1 - len(a), len(b))
    best = np.lexsort((offsets, np.abs(offsets), -histogram))[:tries]
    found = []
    for k in best[histogram[best] >= MIN_MATCHES]:
        offset = int(offsets[k])
        x, y = a[max(0, -offset) : len(b) - offset], b[max(0, offset) : len(a) + offset]
        found.append((float(np.bitwise_count(x ^ y).sum()) / (32 * len(x)), -int(histogram[k]), abs(offset), offset, len(x)))
    if not found:
        return None, 1.0, 0
    error, _, _, offset, overlap = min(found)
    return offset, error, overlap


def _column(rows: DataFrame, schema: T.StructType, media: str, compute) -> DataFrame:
    """Replaces the media column, which comes last, by what `compute` gives for each value."""
    width = len(rows.columns) - 1
    fields = list(schema)[width:]

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                found = list(zip(*[compute(x.as_py()) for x in batch.column(width).slice(k, 64)]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 64) for c in range(width)), *(pa.array(v, arrow.field(f.name).type) for v, f in zip(found, fields))], schema=arrow)

    return rows.mapInArrow(run, schema)


def fingerprint_column(rows: DataFrame, *, id_col: str, media_col: str = "audio") -> DataFrame:
    """id and codes (signed 32-bit) of every recording. An id column named `codes` could not be told from the result's own."""
    if id_col.lower() == "codes":
        raise ValueError("rename the id column")
    source = rows.select(id_col, F.col(media_col).cast("binary").alias("_media"))
    schema = T.StructType([source.schema[id_col], T.StructField("codes", T.ArrayType(T.IntegerType()))])
    return _column(source, schema, "_media", lambda x: (fingerprint(x).view(np.int32),))


def search(library: DataFrame, queries: DataFrame, *, id_col: str, most_error: float = 0.3) -> DataFrame:
    """(query, match, offset, bit_error, overlap): pairs of a stated query set and the library that align.

    Both are (id, codes). Recordings with equal codes are one first. A held tone repeats its code for many frames, so a run of
    equal codes posts its ends alone, and a recording posts a code once, whatever its places. Pairs of the query set and
    the library that share `MIN_MATCHES` such codes, counted before anything else, or all of them, are aligned on their whole codes.
    """
    whole = lambda df: df.select(F.col(id_col).alias("id"), "codes").where(F.size("codes") > 0).withColumn("key", F.xxhash64("codes"))
    held, asked = cut(whole(library)), cut(whole(queries))
    distinct = lambda df: df.groupBy("key").agg(F.any_value("codes").alias("codes"))
    end = lambda x, k: (k == 0) | (x != F.get(F.col("codes"), k - 1)) | (k == F.size("codes") - 1) | (x != F.get(F.col("codes"), k + 1))
    post = lambda df, name: df.select(F.col("key").alias(name), F.explode(F.array_distinct(F.filter("codes", end))).alias("code"))
    left, right = cut(distinct(asked)), cut(distinct(held))
    shared = post(left, "q").join(post(right, "m"), "code").groupBy("q", "m").agg(F.count(F.lit(1)).alias("n"))
    # two codes that are equal throughout share few distinct ones, so a recording also meets its own copies
    pairs = shared.where(F.col("n") >= MIN_MATCHES).select("q", "m").unionByName(left.join(right, "key").select(F.col("key").alias("q"), F.col("key").alias("m"))).distinct()
    both = pairs.join(left.select(F.col("key").alias("q"), F.col("codes").alias("a")), "q").join(right.select(F.col("key").alias("m"), F.col("codes").alias("b")), "m")
    aligned = cut(align_columns(both.select("q", "m", "a", "b"), "a", "b").where(F.col("bit_error") <= most_error))
    named = aligned.join(asked.select(F.col("id").alias("query"), F.col("key").alias("q")), "q").join(held.select(F.col("id").alias("match"), F.col("key").alias("m")), "m")
    return named.select("query", "match", "offset", "bit_error", "overlap")


def align_columns(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The other columns with offset, bit_error and overlap of two columns of codes."""
    rest = [c for c in rows.columns if c not in (a, b)]
    source = rows.select(*rest, a, b)
    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField("offset", T.IntegerType()), T.StructField("bit_error", T.DoubleType()), T.StructField("overlap", T.IntegerType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        as_codes = lambda x: np.array(x.as_py() or [], np.int32).view(np.uint32)
        for batch in batches:
            found = [align(as_codes(x), as_codes(y)) for x, y in zip(batch.column(len(rest)), batch.column(len(rest) + 1))]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(rest))), *(pa.array(v, f.type) for v, f in zip(columns, list(arrow)[len(rest) :]))], schema=arrow)

    return source.mapInArrow(run, schema)


def recording(values: list[float] | None, rate: int = 4096, note: int = 512) -> np.ndarray:
    """A melody that plays each value as a pair of tones; the test bed for tables without media."""
    if not values:
        return np.zeros(0, np.float32)
    x = np.nan_to_num(np.array([v or 0.0 for v in values], float))
    step = np.floor(np.clip(x * 6 + 0.5, 0, 0.999) * 25)
    hz = np.repeat(220.0 * 2 ** (step / 12), note)
    phase = 2 * np.pi * np.cumsum(hz) / rate
    return (0.4 * np.sin(phase) + 0.2 * np.sin(1.5 * phase)).astype(np.float32)


def excerpt(samples: np.ndarray, first: int, seed: int, noise: float = 0.02) -> np.ndarray:
    """Half of a recording from sample `first` on, with noise."""
    part = samples[first : first + len(samples) // 2]
    return part + noise * np.random.default_rng(seed).standard_normal(len(part)).astype(np.float32)


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings` as a recording: its codes, and where a noisy excerpt of it aligns.

    The excerpt starts `vec_id % 40` frames in, which is the offset to find.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.struct("vec_id", "embedding").alias("_media"))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("codes", "part"))])

    def compute(row) -> tuple:
        vec_id = (row or {}).get("vec_id") or 0
        samples = recording((row or {}).get("embedding"))
        sound = write_wav(samples, 4096), write_wav(excerpt(samples, HOP * (vec_id % 40), vec_id), 4096)
        return tuple(fingerprint(s).view(np.int32) for s in sound)

    made = _column(rows, schema, "_media", compute)
    kept = made.select("vec_id", F.size("codes").cast("long").alias("n_codes"), F.crc32(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 8, "0")), "").cast("binary")).alias("codes_crc32"), "part", "codes")
    return align_columns(kept, "part", "codes")


def chroma_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy excerpts of every fiftieth recording, searched in all recordings."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", F.struct("vec_id", "embedding").alias("_media"))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def made(part: bool):
        def compute(row) -> tuple:
            samples = recording(row["embedding"])
            sound = excerpt(samples, HOP * (row["vec_id"] % 40), row["vec_id"]) if part else samples
            return (fingerprint(write_wav(sound, 4096)).view(np.int32),)

        return compute

    library, queries = _column(rows, schema, "_media", made(False)), _column(rows.where("vec_id % 50 = 0"), schema, "_media", made(True))
    return search(library, queries, id_col="vec_id")
