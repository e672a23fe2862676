"""Audio columns: text bytes as 8-bit sound, and features of what was stored.

``store`` writes each payload as a mono WAV of unsigned 8-bit samples. ``features`` reads the stored bytes
back, resamples them with a polyphase filter, takes overlapped log-mel frames and cuts the sound into
active segments by energy with hysteresis. Frames are kept as fixed-shape Arrow tensors of
``CHUNK_FRAMES`` x ``MELS``, one Arrow stream per row, with the time span of each tensor. Work and memory beside the
stored bytes are bounded: a long sound is analysed ``STRIDE`` tensors at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketlens.llm.bpe import _spread

RATE, UP, DOWN = 16_000, 1, 2
TAPS = 16  # of each phase
FRAME, HOP, MELS = 256, 128, 32
CHUNK_FRAMES, STRIDE = 64, 32
#: Energy in standard deviations above the mean at which a segment opens, and below which it closes.
OPEN_AT, CLOSE_AT = 0.5, -0.25
UNIT = 64

SPAN = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
_SPAN = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
STORED = {"n_bytes": T.LongType(), "media": T.BinaryType()}
FEATURES = {
    "payload_bytes": T.LongType(),
    "payload_sha256": T.StringType(),
    "tail_crc32": T.LongType(),
    "tensors": T.BinaryType(),
    "tensor_spans": SPAN,
    "segments": SPAN,
    "feature": T.StringType(),
}


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[int, bytes]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.getframerate(), w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ``UNIT``."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """A windowed sinc at the lower of the two rates, dealt to ``up`` phases of ``TAPS`` taps."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n)
    return (h / h.sum() * up).reshape(TAPS, up).T


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` with ``TAPS - 1`` earlier samples in front, at rate times up / down. Output m of a phase reads inputs from a fixed distance."""
    h = _phases(up, down)
    n = (len(x) - TAPS + 1) * up // down
    y = np.empty(n)
    seen = sliding_window_view(x, TAPS)
    for r in range(min(up, n)):
        k = len(range(r, n, up))
        y[r::up] = seen[(r * down) // up :: down][:k] @ h[(r * down) % up][::-1]
    return y


@lru_cache(maxsize=8)
def _mel(rate: int) -> np.ndarray:
    """Triangles evenly spaced in mel up to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])))


def log_mel(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, MELS) and their energies; the last frame is completed with silence."""
    raw = np.frombuffer(payload, np.uint8)
    n_out = len(raw) * UP // DOWN
    n_frames = max(1, -(-(n_out - FRAME) // HOP) + 1)
    window, bank = np.hanning(FRAME), _mel(rate * UP // DOWN)
    mels, energy = [], []
    step = CHUNK_FRAMES * STRIDE
    for at in range(0, n_frames, step):
        k = min(step, n_frames - at)
        lo, hi = at * HOP * DOWN // UP, ((at + k - 1) * HOP + FRAME) * DOWN // UP
        x = np.zeros(hi - lo + TAPS - 1)
        got = raw[max(0, lo - TAPS + 1) : hi]
        put = max(0, TAPS - 1 - lo)
        x[put : put + len(got)] = (got.astype(np.float64) - 128) / 128
        y = resample(x)
        frames = sliding_window_view(y, FRAME)[::HOP][:k] * window
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        energy.append(np.log(power.sum(1) + 1e-9))
        mels.append(np.log(power @ bank + 1e-6))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that open above one level and close below a lower one."""
    sd = energy.std()
    if sd < 1e-9:
        return []
    z = (energy - energy.mean()) / sd
    event = np.where(z > OPEN_AT, 1, np.where(z < CLOSE_AT, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(z)), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def to_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream with one fixed-shape tensor per ``CHUNK_FRAMES`` frames; the last is filled with the floor."""
    n = -(-len(mel) // CHUNK_FRAMES)
    full = np.full((n * CHUNK_FRAMES, MELS), np.log(1e-6), np.float32)
    full[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, CHUNK_FRAMES, MELS))
    out = pa.BufferOutputStream()
    table = pa.table({"log_mel": column})
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def from_tensors(data: bytes) -> np.ndarray:
    """(tensors, CHUNK_FRAMES, MELS)."""
    return pa.ipc.open_stream(data).read_all()["log_mel"].combine_chunks().to_numpy_ndarray()


def analyse(media: bytes) -> tuple:
    rate, payload = from_wav(media)
    mel, energy = log_mel(payload, rate)
    hop = HOP * DOWN / UP / rate
    end = lambda frame: frame * hop + FRAME * DOWN / UP / rate  # noqa: E731  of the last sample of a frame
    spans = [{"start_s": a * hop, "end_s": end(min(a + CHUNK_FRAMES, len(mel)) - 1)} for a in range(0, len(mel), CHUNK_FRAMES)]
    active = segments(energy)
    mean = np.round(mel.mean(0, dtype=np.float64), 2) + 0.0
    feature = f"{len(mel)}|{len(active)}|{sum(b - a for a, b in active)}|{energy.mean():.2f}|" + ",".join(f"{v:.2f}" for v in mean)
    cut = [{"start_s": a * hop, "end_s": end(b - 1)} for a, b in active]
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), to_tensors(mel), spans, cut, feature


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_bytes (of the text in UTF-8; null: 0) and media (the WAV). Own columns of these names give way."""
    docs = docs.drop(*[c for c in STORED if c in docs.columns])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _spread(big):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()]
                own = [pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(padded(d)) for d in data], pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, *STORED])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in STORED.items())]))


def features(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Add what ``FEATURES`` names, read from the stored bytes: the payload's size, digest and the CRC-32 of its last
    64 bytes, tensors with spans, segments and a summary. Null media counts as 64 zero bytes stored. Equal media, equal values."""
    stored = stored.drop(*[c for c in FEATURES if c in stored.columns])
    at = stored.columns.index(media_col)
    types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), _SPAN, _SPAN, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _spread(big):
                got = [analyse(m if m is not None else to_wav(padded(b""))) for m in b.column(at).to_pylist()]
                own = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, *FEATURES])

    return stored.mapInArrow(run, T.StructType([*stored.schema.fields, *(T.StructField(k, v) for k, v in FEATURES.items())]))
