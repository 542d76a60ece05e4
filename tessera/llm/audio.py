"""Audio features of 8-bit samples: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy
segmentation, kept as fixed-shape Arrow tensors with time spans."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bytes_of, with_arrow


@dataclass(frozen=True)
class Settings:
    """rate: samples a second of the stored form; up / down: the resampling ratio; taps: of each phase's filter;
    window, hop: of a frame, in resampled samples; mels: bands; frames: of a tensor; on, off: thresholds in decibels
    against the text's mean frame energy."""

    rate: int = 8000
    up: int = 3
    down: int = 4
    taps: int = 8
    window: int = 256
    hop: int = 128
    mels: int = 24
    frames: int = 32
    on: float = 1.0
    off: float = -1.0


MEDIA = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("n_frames", T.LongType()), T.StructField("tensors", T.BinaryType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
])


def padded(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_wav(samples: bytes, rate: int) -> bytes:
    """A RIFF WAVE file of one channel of unsigned 8-bit PCM samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> bytes:
    """The samples of what to_wav() gave."""
    (n,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + n]


def phases(s: Settings) -> np.ndarray:
    """A windowed-sinc low-pass filter dealt to ``up`` phases; each phase sums to 1."""
    n = s.up * s.taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(s.up, s.down)) * np.hanning(n + 2)[1:-1]
    table = h.reshape(s.taps, s.up).T[:, ::-1]
    return (table / table.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, s: Settings, table: np.ndarray) -> np.ndarray:
    """Every output from its phase's taps alone: nothing is computed that ``down`` would drop."""
    n = -(-len(x) * s.up // s.down)
    ext = np.concatenate([np.full(s.taps, x[0], np.float32), x, np.full(s.taps + s.down, x[-1], np.float32)])
    out = np.empty(n, np.float32)
    for p in range(s.up):
        k = -(-(n - p) // s.up)
        if k <= 0:
            continue
        # outputs p, p + up, ...: their input positions rise by down
        begin, phase = (p * s.down) // s.up, (p * s.down) % s.up
        first = begin + s.taps // 2 + 1
        acc = np.zeros(k, np.float32)
        for j in range(s.taps):
            acc += table[phase, j] * ext[first + j : first + j + (k - 1) * s.down + 1 : s.down]
        out[p :: s.up] = acc
    return out


def mel_bank(s: Settings) -> np.ndarray:
    """Triangular bands, evenly spaced on the mel scale."""
    rate = s.rate * s.up / s.down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), s.mels + 2) / 2595) - 1)
    f = np.arange(s.window // 2 + 1) * rate / s.window
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return (bank + 1e-6).T.astype(np.float32)


def log_mel(y: np.ndarray, s: Settings, hann: np.ndarray, bank: np.ndarray, step: int = 2048) -> np.ndarray:
    """Log-mel energies of overlapping frames, (frames, mels); the last frame is filled with zeros."""
    n = max(1, -(-(len(y) - s.window) // s.hop) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * s.hop + s.window - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, s.window)[:: s.hop]
    out = np.empty((n, s.mels), np.float32)
    for i in range(0, n, step):
        spec = np.fft.rfft(frames[i : i + step] * hann)
        out[i : i + step] = np.log((spec.real**2 + spec.imag**2).astype(np.float32) @ bank + 1e-3)
    return out


def segments(energy: np.ndarray, on: float, off: float) -> np.ndarray:
    """[begin, end) frames of sound: it starts at ``on`` or above and lasts until the energy falls below ``off``."""
    mark = np.where(energy >= on, 1, np.where(energy < off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[last], -1) > 0
    edge = np.diff(np.concatenate([[False], state, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def tensor_type(s: Settings) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (s.frames, s.mels), dim_names=("frame", "mel"))


def to_tensors(mel: np.ndarray, s: Settings) -> bytes:
    """An Arrow IPC stream of (start_s, end_s, n_frames, log_mel): fixed-shape tensors, the last filled with zeros."""
    n = -(-len(mel) // s.frames)
    full = np.zeros((n * s.frames, s.mels), np.float32)
    full[: len(mel)] = mel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), s.frames * s.mels)
    second = s.hop / (s.rate * s.up / s.down)
    begin = np.arange(n) * s.frames
    count = np.minimum(s.frames, len(mel) - begin)
    batch = pa.RecordBatch.from_arrays([pa.array(begin * second), pa.array((begin + count) * second), pa.array(count.astype(np.int32)), pa.ExtensionArray.from_storage(tensor_type(s), storage)], names=["start_s", "end_s", "n_frames", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def from_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Extractor:
    def __init__(self, s: Settings):
        self.s, self.table, self.bank = s, phases(s), mel_bank(s)
        self.hann = np.hanning(s.window + 1)[:-1].astype(np.float32)

    def features(self, samples: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel energies and the spans of sound in seconds."""
        s = self.s
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        mel = log_mel(resample(x, s, self.table), s, self.hann, self.bank)
        energy = np.logaddexp.reduce(mel, axis=1) * (10 / np.log(10))
        spans = segments(energy - energy.mean(dtype=np.float64), s.on, s.off) * (s.hop / (s.rate * s.up / s.down))
        return mel, spans

    def row(self, raw: bytes) -> tuple:
        media = to_wav(padded(raw), self.s.rate)
        back = from_wav(media)
        mel, spans = self.features(back)
        return len(raw), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(mel), to_tensors(mel, self.s), [{"start_s": a, "end_s": b} for a, b in spans.tolist()]


def audio_features(docs: DataFrame, text: str = "text", settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Append the stored form of each text's bytes as 8-bit samples and its features (columns of MEDIA).

    Null and empty texts are 64 zero samples. Texts are used whole, one at a time. Equal texts get equal values, so
    repeated rows do too. Columns named like a new one are replaced. An empty table gives an empty result. A WAVE file's
    length has 32 bits; a Spark string is shorter than that.
    """

    def make():
        extract = Extractor(settings)

        def step(batch: pa.RecordBatch) -> list:
            rows = [extract.row(x) for x in bytes_of(batch, text)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in MEDIA]

        return step

    return with_arrow(docs, MEDIA, make, text, keep)
