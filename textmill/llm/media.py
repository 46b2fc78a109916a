"""Media columns: audio features as fixed-shape tensors with time spans.

A payload of bytes is stored without loss as 8-bit mono PCM in a WAV
container (``store``), read back (``samples``), and turned into features:

* polyphase resampling by 2/3 (a 24-tap windowed-sinc low-pass per phase;
  the phases are one strided matrix product);
* log-mel energies over frames of 256 samples, 128 apart, Hann-windowed;
* segments by an energy gate with hysteresis: a segment opens at the upper
  threshold and closes below the lower one, both relative to the median;
* tensors of ``FRAMES`` x ``MELS`` float32 (the last one zero-filled), each
  with its time span.

The tensors are stored as Arrow streams of a ``fixed_shape_tensor`` column
with the spans beside it, some documents in a stream, as a binary column of a
table in the shared folder; features are read back from there.

Null texts count as empty; every text has at least one block of 192 samples;
null ids and repeated rows are rows like others; an empty table gives an empty
result; other columns are ignored.  Equal texts give equal values: each text is
transformed on its own, a fixed number of frames at a time, so that what is
made on the way doesn't grow with its length (its bytes and its features, 0.4
bytes for each, do).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, one_thread, slices, text_or_empty

RATE, UP, DOWN, TAPS = 12_000, 2, 3, 24
FRAME, HOP, MELS, FRAMES = 256, 128, 20, 16
#: Frames that are made at a time.
PIECE = 2048
BLOCK = 192
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments long, spans_ms array<struct<start: long, end: long>>"


def store(payload: bytes) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def samples(media: bytes) -> bytes:
    """The payload of a stored file; its header is checked."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _phases() -> np.ndarray:
    """Low-pass taps for each of the UP output phases, [TAPS, UP]."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS * UP) / DOWN * UP
    return np.ascontiguousarray(h.reshape(TAPS, UP)[::-1].astype(np.float32))


def resample(x: np.ndarray) -> np.ndarray:
    """2/3 of the samples: output j is phase (j*DOWN) mod UP at j*DOWN//UP."""
    taps = _phases()
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[: len(x) : DOWN]
    later = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[1 : len(x) + 1 : DOWN][: len(frames)]
    return np.stack([frames @ taps[:, 0], later @ taps[:, 1]], 1).ravel()


def _filterbank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(mel(60), mel(top), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, DOWN / UP / RATE)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


_TABLES: dict[str, np.ndarray] = {}


def frames_of(n: int) -> int:
    """Frames of n resampled samples: the last that is whole, one at least."""
    return 1 + max(0, n - FRAME) // HOP


def logmel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[frames, MELS] log-mel energies and [frames] mean energies of x, which
    has at least FRAME samples."""
    if not _TABLES:
        _TABLES.update(bank=_filterbank(), window=np.hanning(FRAME).astype(np.float32))
    part = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _TABLES["window"]
    power = np.abs(np.fft.rfft(part, axis=1)) ** 2
    return np.log(power.astype(np.float32) @ _TABLES["bank"] + 1e-6), (part * part).mean(1)


def segments(energy: np.ndarray, upper: float = 1.1, lower: float = 0.9) -> list[tuple[int, int]]:
    """[first, end) frames of the stretches that reach ``upper`` times the
    median energy, from there until it is below ``lower`` times."""
    mid = float(np.median(energy)) if len(energy) else 0.0
    state = np.where(energy >= upper * mid, 1, np.where(energy < lower * mid, -1, 0)) if mid > 0 else np.full(len(energy), -1)
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (np.where(last >= 0, state[last], -1) > 0).astype(np.int8)
    turn = np.diff(on, prepend=0, append=0)
    return list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True))


def tensors(mels: np.ndarray) -> tuple[pa.ExtensionArray, list[tuple[int, int]]]:
    """Fixed-shape tensor array and each tensor's time span in milliseconds."""
    n = -(-len(mels) // FRAMES)
    filled = np.zeros((n * FRAMES, MELS), np.float32)
    filled[: len(mels)] = mels
    array = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, FRAMES, MELS))
    return array, [(_ms(i * FRAMES), _ms(min(len(mels), (i + 1) * FRAMES))) for i in range(n)]


def _ms(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (UP * RATE)


def features(payload: bytes, piece: int = PIECE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel energies and segments.  ``piece`` frames are made at a time,
    from the samples that they and the low-pass reach; the values are the same
    for every ``piece``."""
    data = np.frombuffer(payload, np.uint8)
    n = -(-len(data) // DOWN) * UP  # resampled samples
    count = frames_of(n)
    mels, energy = np.empty((count, MELS), np.float32), np.empty(count, np.float32)
    for at in range(0, count, piece):
        end = min(count, at + piece)
        first, last = at * HOP, min(n, (end - 1) * HOP + FRAME)
        # resampled sample j ends at input sample j * DOWN / UP; HOP is even
        low = first // UP * DOWN
        high = min(len(data), -(-last // UP) * DOWN)
        before = min(low, (TAPS + DOWN - 1) // DOWN * DOWN)
        x = (data[low - before : high].astype(np.float32) - 128) / 128
        y = resample(x)[before // DOWN * UP :][: last - first]
        if len(y) < FRAME:
            y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
        mels[at:end], energy[at:end] = logmel(y)
    return mels, segments(energy)


def padded(text: bytes) -> bytes:
    n = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text + b" " * (n - len(text))


def store_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a lossless 8-bit WAV file."""
    def stored(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([store(padded(t)) for t in texts], pa.binary())})

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def tensor_stream(found: list[np.ndarray]) -> bytes:
    """An Arrow stream of all documents' tensors: (doc: its place in the list,
    start_ms, end_ms, tensor)."""
    made = [tensors(m) for m in found]
    spans = [s for _, own in made for s in own]
    doc = np.repeat(np.arange(len(made)), [len(own) for _, own in made]).astype(np.int32)
    array = pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate([a.to_numpy_ndarray() for a, _ in made]))
    batch = pa.record_batch([pa.array(doc), *(pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1)), array], names=["doc", "start_ms", "end_ms", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[tensors] documents, [tensors, 2] spans in milliseconds and [tensors,
    FRAMES, MELS] values, views of the stream."""
    with pa.ipc.open_stream(stream) as reader:
        batch = reader.read_next_batch()
    kind = batch.schema.field("tensor").type
    if not isinstance(kind, pa.FixedShapeTensorType) or list(kind.shape) != [FRAMES, MELS]:
        raise ValueError("not a stream of tensors of this shape")
    return batch.column("doc").to_numpy(), np.stack([batch.column(k).to_numpy() for k in ("start_ms", "end_ms")], 1), batch.column("tensor").to_numpy_ndarray()


STORED = "docs array<struct<doc_id: long, n_bytes: long, payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string, spans_ms: array<struct<start: long, end: long>>>>, tensors binary"
_SPANS = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
_ABOUT = pa.struct({"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "spans_ms": _SPANS})


def store_tensors(media: DataFrame) -> DataFrame:
    """STORED: the features of stored files, some documents in a row, with
    what identifies each; written to the shared folder."""
    def made(batches):
        one_thread()
        for batch in slices(batches, "media", 4 << 20):
            about, found = [], []
            for doc, n, m in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media")), strict=True):
                payload = samples(m)
                mels, own = features(payload)
                found.append(mels)
                about.append({"doc_id": doc, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "spans_ms": [{"start": _ms(a), "end": _ms(b)} for a, b in own]})
            if about:
                yield pa.record_batch({"docs": pa.array([about], pa.list_(_ABOUT)), "tensors": pa.array([tensor_stream(found)], pa.binary())})

    return cut(media.mapInArrow(made, STORED))


def audio_tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, start_ms, end_ms, tensor): one row for each tensor, its float32
    values in row-major order [FRAMES, MELS], read from the streams."""
    def rows(batches):
        for batch in batches:
            for about, stream in zip(batch.column("ids").to_pylist(), batch.column("tensors").to_pylist(), strict=True):
                doc, spans, values = read_tensors(stream)
                yield pa.record_batch({"doc_id": pa.array(about, pa.int64()).take(pa.array(doc)), "start_ms": pa.array(spans[:, 0]), "end_ms": pa.array(spans[:, 1]), "tensor": pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS).cast(pa.list_(pa.float32()))})

    return stored.select(F.col("docs.doc_id").alias("ids"), "tensors").mapInArrow(rows, "doc_id long, start_ms long, end_ms long, tensor array<float>")


def digest(stored: DataFrame) -> DataFrame:
    """The digest columns, the features' from the stored tensors read back."""
    def rows(batches):
        for batch in batches:
            for about, stream in zip(batch.column("docs"), batch.column("tensors").to_pylist(), strict=True):
                own = pa.RecordBatch.from_struct_array(about.values)
                doc, spans, values = read_tensors(stream)
                start = np.searchsorted(doc, np.arange(own.num_rows + 1))
                text = []
                for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                    sha = hashlib.sha256(np.ascontiguousarray(values[a:b])).hexdigest()[:16]
                    frames = max(1, round(int(spans[b - 1, 1]) * UP * RATE / (HOP * 1000 * DOWN)))
                    mean = values[a:b].sum((0, 1), dtype=np.float64) / frames
                    text.append(f"{b - a}x{FRAMES}x{MELS} {sha} " + " ".join(f"{v:.3f}" for v in mean.tolist()))
                spans_ms = own.column("spans_ms")
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(7)), pa.array(text, pa.string()), pc.cast(pc.list_value_length(spans_ms), pa.int64()), spans_ms], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "spans_ms"])

    return stored.mapInArrow(rows, DIGEST)
