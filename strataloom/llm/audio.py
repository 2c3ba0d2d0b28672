"""Audio features of a media column: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy
segmentation, stored as fixed-shape Arrow tensors with time spans.

A media value is a mono WAV file of 8-bit samples. Features are resampled from RATE to TARGET, framed,
turned into log-mel energies and cut into clips of CLIP frames, the last one padded with the floor value.
A value's tensors are an Arrow stream whose column is a fixed-shape tensor (CLIP, MELS) beside each clip's
start and end in milliseconds. Segments open where a frame's energy rises over one threshold and close
where it falls below a lower one.
"""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples a second as stored and as analysed; the ratio's terms; taps a phase.
RATE, TARGET, UP, DOWN, TAPS = 24_000, 16_000, 2, 3, 12
FRAME, HOP, FFT, MELS, CLIP = 400, 160, 512, 40, 32
#: Segments open HIGH and close LOW standard deviations from the mean log energy.
HIGH, LOW = 0.5, -0.5
FLOOR = 1e-6
#: Payloads are padded with byte 255 to a positive multiple of this many bytes.
BLOCK, TAIL = 576, 32


# ---------------------------------------------------------------- the stored form


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono WAV file of 8-bit samples; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit samples are read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAV file")


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // block)) * block - len(data))


# ---------------------------------------------------------------- features


def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed sinc low-pass filter, one row a phase."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(up * taps)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32)


def mel_bank(rate: int = TARGET, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (fft // 2 + 1, mels)."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1]
    fall = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[None, 1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Analyser:
    """Filters and windows, made once a worker."""

    def __init__(self):
        self.phases, self.bank = phases(), mel_bank()
        self.window = np.hanning(FRAME).astype(np.float32)

    def resample(self, x: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
        """Polyphase: output k takes phase (k * DOWN) % UP of the filter at input (k * DOWN) // UP. Outputs are made `at_once`, so that the windows of a long value never stand in memory together."""
        half = TAPS // 2
        spans = np.lib.stride_tricks.sliding_window_view(np.pad(x, (half, half + DOWN)), TAPS)
        out = np.empty(len(x) * UP // DOWN, np.float32)
        for at in range(0, len(out), at_once):
            k = np.arange(at, min(at + at_once, len(out)))
            for phase in range(UP):
                mine = k[k * DOWN % UP == phase]
                if len(mine):
                    step = (mine * DOWN) // UP
                    out[mine] = spans[step[0] : step[-1] + 1 : DOWN] @ self.phases[phase][::-1]
        return out

    def log_mel(self, samples: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(frames, MELS) log-mel energies, and the frames' log energies."""
        x = self.resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
        x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP))  # the last frame is full
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        mels, energy = [], []
        for at in range(0, len(frames), 1024):  # bounded memory for long values
            part = frames[at : at + 1024] * self.window
            power = np.abs(np.fft.rfft(part, FFT).astype(np.complex64)) ** 2
            mels.append(np.log(power @ self.bank + FLOOR))
            energy.append(np.log((part**2).mean(axis=1) + FLOOR))
        return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame spans [start, end) by hysteresis: what the last crossing said holds until the other threshold is crossed."""
    z = (energy - energy.mean()) / (energy.std() + 1e-9)
    said = np.where(z >= high, 1, np.where(z <= low, 0, -1))
    last = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
    on = np.where(last >= 0, said[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 // TARGET


def tensor_stream(mels: np.ndarray) -> bytes:
    """The clips as an Arrow stream: start_ms, end_ms and a fixed-shape tensor (CLIP, MELS)."""
    n = -(-len(mels) // CLIP)
    full = np.full((n * CLIP, MELS), np.log(FLOOR), np.float32)
    full[: len(mels)] = mels
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, CLIP, MELS))
    starts = [milliseconds(k * CLIP) for k in range(n)]
    ends = [milliseconds(min(len(mels), (k + 1) * CLIP)) for k in range(n)]
    batch = pa.record_batch([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), tensors], ["start_ms", "end_ms", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


# ---------------------------------------------------------------- Spark


def stored_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as the samples of a WAV file. Null: no bytes before padding."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = [t or b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array([to_wav(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, f"doc_id {kind}, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """A row a media value: doc_id, n_bytes, payload (as read back), media_bytes, media_sha256, tensors, segments (array of start_ms, end_ms) and mean_log_mel.

    The WAV values are read as stored. A null value gives nulls. Values of any length are taken whole, in
    resampled and framed in parts of bounded size; repeated rows are computed each; an empty table gives an empty table.
    """

    def work(batches):
        analyser = Analyser()
        span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[], [], [], [], [], []]
                for value in part.column("media").to_pylist():
                    row: tuple = (None,) * 6
                    if value is not None:
                        payload, _ = from_wav(value)
                        mels, energy = analyser.log_mel(payload)
                        spans = [{"start_ms": milliseconds(a), "end_ms": milliseconds(b)} for a, b in segments(energy)]
                        row = (payload, len(value), hashlib.sha256(value).hexdigest(), tensor_stream(mels), spans, mels.mean(axis=0, dtype=np.float64).tolist())
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                types = [pa.binary(), pa.int64(), pa.string(), pa.binary(), span, pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                    ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "tensors", "segments", "mean_log_mel"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        work, f"doc_id {kind}, n_bytes long, payload binary, media_bytes long, media_sha256 string, tensors binary, segments array<struct<start_ms: long, end_ms: long>>, mean_log_mel array<double>"
    )


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of audio_features' columns; `feature` names the number of segments, a digest of the tensors and the mean log-mel energies."""
    found = audio_features(stored_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    means = F.array_join(F.transform("mean_log_mel", lambda x: F.format_number(x, 3)), " ")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{TAIL}, {TAIL})")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(";", F.size("segments"), F.sha2("tensors", 256), means).alias("feature"),
    )

