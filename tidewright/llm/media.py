"""Media columns: lossless 8-bit audio with log-mel tensors and energy segments."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Samples a second as stored and as analysed; their ratio is UP / DOWN.
STORED_HZ, HZ, UP, DOWN = 12_000, 8_000, 2, 3
UNIT = 192
TAPS = 16
WINDOW, HOP, FFT, MELS = 200, 80, 256, 32
#: Frames in one tensor, and frames that are transformed together.
FRAMES, BLOCK = 16, 4096
FLOOR = 1e-8


def _le(n: Column, size: int) -> Column:
    """An integer as little-endian bytes."""
    h = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k - 1, 2) for k in range(size, 0, -1))))


def wav(payload: Column) -> Column:
    """The bytes as the samples of a mono 8-bit PCM WAV file; nothing is lost. Built inside the JVM."""
    n = F.octet_length(payload).cast("long")
    ascii_ = lambda s: F.lit(s).cast("binary")
    fixed = bytes([16, 0, 0, 0, 1, 0, 1, 0]) + STORED_HZ.to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0])
    return F.concat(ascii_("RIFF"), _le(n + 36, 4), ascii_("WAVEfmt "), F.lit(fixed), ascii_("data"), _le(n, 4), payload)


def samples(media: Column) -> Column:
    """The stored bytes, read back from behind the 44 bytes of header."""
    return F.substring(media, 45, 2_147_483_647)


def payload(text: Column) -> Column:
    """UTF-8 and spaces up to a positive multiple of UNIT; null counts as empty."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    return F.concat(raw, F.repeat(F.lit(" "), (F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT) - n).cast("int")).cast("binary"))


@cache
def _design() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low-pass branches of the resampler, the window, and the mel filters."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / DOWN) / DOWN * np.hamming(TAPS * UP) * UP
    branches = h.reshape(TAPS, UP).T[:, ::-1].astype(np.float32)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(HZ / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * HZ / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return branches, np.hanning(WINDOW).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN: each output takes one branch of the filter over TAPS inputs."""
    branches = _design()[0]
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(TAPS, np.float32)])
    out = np.empty(n, np.float32)
    for k in range(UP):  # outputs k, k + UP, ... share a branch, and their inputs lie DOWN apart
        start, phase = divmod(k * DOWN, UP)
        m = len(range(k, n, UP))
        windows = np.lib.stride_tricks.as_strided(padded[start:], (m, TAPS), (4 * DOWN, 4))
        out[k::UP] = windows @ branches[phase]
    return out


def log_mel(y: np.ndarray) -> np.ndarray:
    """Overlapped log-mel frames; a signal shorter than a window gives one frame. Blocks bound the memory."""
    _, window, filters = _design()
    n = max(1, 1 + -(-(len(y) - WINDOW) // HOP))
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(y)), np.float32)])
    frames = np.lib.stride_tricks.as_strided(y, (n, WINDOW), (4 * HOP, 4))
    out = np.empty((n, MELS), np.float32)
    for a in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[a : a + BLOCK] * window, FFT)
        out[a : a + BLOCK] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ filters + FLOOR)
    return np.round(out, 2)


def segments(energy: np.ndarray) -> np.ndarray:
    """Runs of frames that begin at mean + half a deviation and end below the mean (hysteresis)."""
    mean, spread = energy.mean(), energy.std()
    mark = np.where(energy >= mean + spread / 2, 1, np.where(energy < mean, -1, 0))
    mark[0] = mark[0] or -1
    on = mark[np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return edge.reshape(-1, 2)


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors (FRAMES x MELS) with their time spans; the last one is filled with silence."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, MELS), np.log(np.float32(FLOOR)), np.float32)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    start = np.arange(n) * FRAMES * HOP / HZ
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS)
    batch = pa.record_batch({"start_s": start, "end_s": np.minimum(start + FRAMES * HOP / HZ, ((len(mel) - 1) * HOP + WINDOW) / HZ), "log_mel": pa.ExtensionArray.from_storage(kind, values)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(media: bytes) -> dict:
    y = resample((np.frombuffer(media, np.uint8, offset=44).astype(np.float32) - 128) / 128)
    mel = log_mel(y)
    energy = mel.mean(1)
    return {"n_frames": len(mel), "tensors": tensors(mel), "segments": [{"start_s": a * HOP / HZ, "end_s": ((b - 1) * HOP + WINDOW) / HZ, "energy": round(float(energy[a:b].mean()), 2)} for a, b in segments(energy).tolist()]}


FEATURES = "n_frames int, tensors binary, segments array<struct<start_s: double, end_s: double, energy: double>>"


def audio_features(media: Column) -> Column:
    """Features of a WAV column as a struct: n_frames, tensors (an Arrow stream) and segments with time spans.

    Null gives null. The value depends on the bytes alone. Work a row is linear in its length, a block of frames at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(FEATURES))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else features(x) for x in column.to_pylist()], kind)

    return F.arrow_udf(run, FEATURES)(media)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as audio and computes features from the stored bytes.

    Columns: the id, n_bytes, media (WAV), features. A null or empty text is one unit of spaces; whole texts of any length
    are stored; repeated rows give repeated results, an empty table none. No shuffle.
    """
    stored = df.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), wav(payload(F.col(text_col))).alias("media"))
    return stored.withColumn("features", audio_features(F.col("media")))


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The stored bytes read back, and the features, as digests."""
    back = samples(F.col("media"))
    f = F.col("features")
    return df.select(
        id_col,
        "n_bytes",
        F.octet_length(back).cast("long").alias("payload_bytes"),
        F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", f["n_frames"], F.size(f["segments"]), F.sha2(F.concat(f["tensors"], F.to_json(f["segments"]).cast("binary")), 256)).alias("feature"),
    )


def queries() -> dict:
    return {"op2_media_columns": lambda spark, sf_dir: digests(media_columns(table(spark, sf_dir, "documents")))}
