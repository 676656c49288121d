"""Media columns: audio payloads in WAV form, and their log-mel features as fixed-shape Arrow tensors with time spans.

Bytes become 8-bit mono samples, stored losslessly as WAV. Features are computed from the stored bytes as read back:
polyphase resampling, overlapped frames, a log-mel filterbank, and segments by hysteresis on the frame energy. A
recording's frames are cut into tiles of one shape, an Arrow fixed-shape tensor column beside the tiles' time spans.
"""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import crc32, materialize, quiet_threads, table

RATE = 8000
UP, DOWN, TAPS = 3, 8, 24
FRAME, HOP, MELS = 128, 64, 16
TILE_FRAMES = 32
UNIT = 64
BLOCK_FRAMES = 4096
RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_ms:double,end_ms:double>>, tensors binary, summary string"


_made: dict[tuple, np.ndarray] = {}


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM in a RIFF container; the data chunk's length must be even."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a WAV file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            rate = struct.unpack("<I", media[at + 12 : at + 16])[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc of `taps` coefficients for each of `up` phases."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    cut = 1 / max(up, down)
    return (cut * np.sinc(cut * n) * np.hamming(taps * up) * up).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, first: int = 0, last: int | None = None) -> np.ndarray:
    """Samples first to last of the signal resampled by up / down. Each output phase has its own branch of the filter, so no
    zeros are inserted; any range is what it is in the whole."""
    h = _made.get(("h", up, down, taps))
    if h is None:
        h = _made["h", up, down, taps] = low_pass(up, down, taps)
    n = -(-len(x) * up // down)
    last = n if last is None else min(last, n)
    out = np.zeros(max(last - first, 0), np.float32)
    delay = taps // 2
    low = first * down // up - taps + delay  # the first input that the range needs
    high = last * down // up + delay + down + 1
    wide = np.concatenate([np.zeros(max(0, -low), np.float32), x[max(low, 0) : max(high, 0)], np.zeros(max(0, high - len(x)), np.float32)])
    for m in range(first, min(first + up, last)):
        phase, base = m * down % up, m * down // up - low
        count = -(-(last - m) // up)
        branch = np.zeros(count, np.float32)
        for j in range(taps):
            s = base - j + delay
            branch += h[phase + j * up] * wide[s : s + down * (count - 1) + 1 : down]
        out[m - first :: up] = branch
    return out


def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale; [bins, mels]."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - edges[:-2]) / np.diff(edges)[:-1]
    fall = (edges[2:] - f[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, mels: int = MELS) -> np.ndarray:
    """[frames, mels] of overlapped Hann frames; a signal shorter than a frame is padded to one."""
    if len(x) < frame:
        x = np.concatenate([x, np.zeros(frame - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(frame).astype(np.float32))) ** 2
    return np.log(power.astype(np.float32) @ _filters(rate, frame, mels) + 1e-6)


def _filters(*key) -> np.ndarray:
    if key not in _made:
        _made[key] = mel_filters(*key)
    return _made[key]


def hysteresis(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames above low that somewhere exceed high; half-open."""
    step = np.diff(np.concatenate([[0], (energy > low).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return [(int(a), int(b)) for a, b in zip(begin, end, strict=True) if (energy[a:b] > high).any()]


def frame_count(n: int, frame: int = FRAME, hop: int = HOP) -> int:
    """Frames of n samples; a signal shorter than a frame is padded to one."""
    return 1 + max(0, n - frame) // hop


def mel_blocks(samples: np.ndarray, rate: float):
    """log_mel of a recording, BLOCK_FRAMES frames at a time, so that memory does not grow with its length."""
    n = -(-len(samples) * UP // DOWN)
    frames = frame_count(n)
    for i in range(0, frames, BLOCK_FRAMES):
        j = min(i + BLOCK_FRAMES, frames)
        low, high = i * HOP, (j - 1) * HOP + FRAME
        # the inputs of this block, as numbers from -1 to 1, with what the filter reaches beside them
        a = max(0, low * DOWN // UP - 2 * TAPS) // DOWN * DOWN
        b = high * DOWN // UP + 2 * TAPS + DOWN
        x = (samples[a:b].astype(np.float32) - 128) / 128
        shift = a // DOWN * UP
        yield log_mel(resample(x, first=low - shift, last=min(high, n) - shift), rate)


def tensor_file(mel: np.ndarray, hop_ms: float) -> bytes:
    """An Arrow stream: tiles of TILE_FRAMES frames in half precision (the last one padded with zeros) and each one's span."""
    tiles = -(-len(mel) // TILE_FRAMES)
    block = np.zeros((tiles, TILE_FRAMES, mel.shape[1]), np.float16)
    block.reshape(-1, mel.shape[1])[: len(mel)] = mel
    start = np.arange(tiles) * TILE_FRAMES
    columns = [pa.array(start * hop_ms), pa.array(np.minimum(start + TILE_FRAMES, len(mel)) * hop_ms), pa.FixedShapeTensorArray.from_numpy_ndarray(block)]
    batch = pa.RecordBatch.from_arrays(columns, ["start_ms", "end_ms", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans [tiles, 2], tensors [tiles, frames, mels]) of a tensor_file."""
    t = pa.ipc.open_stream(data).read_all()
    return np.stack([t["start_ms"].to_numpy(), t["end_ms"].to_numpy()], 1), t["log_mel"].combine_chunks().to_numpy_ndarray()


def features(samples: bytes, rate: int) -> tuple[list[tuple[float, float]], bytes, str]:
    """(segments in ms, tensor file, summary) of 8-bit samples."""
    hop_ms = 1000 * HOP * DOWN / (rate * UP)
    mel = np.concatenate(list(mel_blocks(np.frombuffer(samples, np.uint8), rate * UP / DOWN)))
    energy = mel.mean(1)
    middle, spread = float(energy.mean()), float(energy.std())
    parts = [(a * hop_ms, b * hop_ms) for a, b in hysteresis(energy, middle + 0.5 * spread, middle - 0.25 * spread)]
    speech = sum(b - a for a, b in parts)
    summary = f"frames={len(mel)};segments={len(parts)};active_ms={speech:.0f};mel=" + ",".join(f"{v:.2f}" for v in mel.mean(0))
    return parts, tensor_file(mel, hop_ms), summary


def _store(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            some = batch.slice(k, 512)
            data = [(t or "").encode() for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(padded(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches):
    quiet_threads()
    segment = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            cols: list[list] = [[] for _ in range(8)]
            for media in some.column(2).to_pylist():
                samples, rate = from_wav(media)
                parts, tensors, summary = features(samples, rate)
                for c, v in zip(cols, (len(samples), hashlib.sha256(samples).hexdigest(), crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), [{"start_ms": a, "end_ms": b} for a, b in parts], tensors, summary), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), segment, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors", "summary"])


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text as a WAV payload to the shared folder and read the table back: doc_id, n_bytes, media.

    A null text is empty: one unit of zero bytes. Repeated rows are stored each; other columns are ignored.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(slim.mapInArrow(_store, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def audio_features(media: DataFrame) -> DataFrame:
    """RESULT for each stored recording, written to the shared folder and read back: the tensors lie beside their recording's
    segments and spans. Equal recordings give equal values. An empty table gives no rows."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return materialize(media.mapInArrow(_read, f"doc_id {kind}, {RESULT}"), "audio-tensors")


def op4_audio_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(store_media(table(spark, sf_dir, "documents")))
    # the feature tells of the tensors as they were read back
    feature = F.concat("summary", F.lit(";tensors="), F.hex(F.crc32("tensors")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op4_audio_tensors": op4_audio_tensors}
ORACLE: dict[str, str] = {}
