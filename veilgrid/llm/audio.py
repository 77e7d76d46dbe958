"""Audio features of stored 8-bit samples (operator 2).

``store_media`` writes each payload as an 8-bit mono WAV file into a binary column in the shared folder; ``features``
reads the stored bytes back, resamples them by a polyphase filter, takes overlapped log-mel filterbanks and segments by
energy with hysteresis. Features leave as an Arrow IPC stream per document with fixed-shape float32 tensors
[block_frames, mels] and the time span of each; segments are (start_s, end_s).

Both steps are row-local: no shuffle, and long payloads are transformed in chunks. Defined cases: a null text is empty;
the empty payload is padded to 64 zero bytes, which give one tensor; equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

RATE, UP, DOWN, TAPS = 12_000, 2, 3, 16
FRAME, HOP, MELS, BLOCK, STEP = 256, 128, 32, 16, 256
HIGH, LOW = 1.0, 0.4
_CHUNK = 1 << 19


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV file; its data chunk is the payload."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_payload(media: bytes) -> bytes:
    kind, n = struct.unpack_from("<4sI", media, 36)
    if media[:4] != b"RIFF" or kind != b"data" or len(media) != 44 + n:
        raise ValueError("not a stored sample file")
    return media[44:]


def store_media(df: DataFrame, block: int = 64) -> DataFrame:
    """df(doc_id, text) -> doc_id, n_bytes, media; written to the shared folder and read back."""

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for at in range(0, len(texts), 1000):
                raw = [(t or "").encode() for t in texts.slice(at, 1000).to_pylist()]
                media = [wav(x + bytes(-len(x) % block or (0 if x else block))) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1000), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    path = new_path(df.sparkSession, "media")
    out = df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, media binary")
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


class LogMel:
    """Resampler, filterbank and segmenter with their constant tables."""

    def __init__(self):
        n = UP * TAPS
        t = np.arange(n) - (n - 1) / 2
        cut = 1 / max(UP, DOWN)
        low_pass = UP * cut * np.sinc(cut * t) * np.hamming(n)
        self.phases = [low_pass[p::UP][::-1].astype(np.float32) for p in range(UP)]
        self.window = np.hanning(FRAME).astype(np.float32)
        rate = RATE * UP / DOWN
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
        f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
        up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
        self.bank = np.maximum(0, np.minimum(up, down))
        self.hop_s, self.frame_s = HOP / rate, FRAME / rate

    def resample(self, samples: np.ndarray) -> np.ndarray:
        """Polyphase: output n uses phase n*DOWN mod UP at input n*DOWN div UP."""
        x = np.concatenate([np.zeros(TAPS - 1, np.float32), samples])
        n = -(-len(samples) * UP // DOWN)
        out = np.empty(n, np.float32)
        for r in range(UP):
            at, taps = r * DOWN // UP, self.phases[r * DOWN % UP]
            m = len(range(r, n, UP))
            y = np.zeros(m, np.float32)
            for k in range(TAPS):
                y += taps[k] * x[at + k :: DOWN][:m]
            out[r::UP] = y
        return out

    def log_mel(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row for each frame start. Values are multiples of 1/STEP, so they do not depend on how frames are batched."""
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)
        out = np.empty((len(starts), MELS), np.float32)
        for at in range(0, len(starts), 2048):
            spectrum = np.fft.rfft(frames[starts[at : at + 2048]] * self.window)
            power = spectrum.real.astype(np.float64) ** 2 + spectrum.imag.astype(np.float64) ** 2
            out[at : at + 2048] = np.rint(np.log(power @ self.bank + 1e-6) * STEP) / STEP
        return out

    def segments(self, mel: np.ndarray) -> np.ndarray:
        """[n, 2] frame spans: opened above mean + HIGH deviations, kept open while above mean + LOW deviations."""
        energy = mel.mean(axis=1)
        level, spread = float(energy.mean()), float(energy.std())
        mark = np.where(energy > level + HIGH * spread, 1, np.where(energy < level + LOW * spread, -1, 0))
        known = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
        on = np.concatenate([[False], (known >= 0) & (mark[known] > 0), [False]]).astype(np.int8)
        step = np.diff(on)
        return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)

    def describe(self, payloads: list[bytes]) -> list[tuple[bytes, list[dict], int]]:
        """Arrow IPC stream of the tensors, segments in seconds and frames of each payload, computed side by side."""
        pieces, at = [], []
        place = 0
        for p in payloads:  # each starts on the common grid of input and output, behind a silent gap as long as the filter
            gap = TAPS + (-(place + TAPS)) % DOWN
            at.append((place + gap) * UP // DOWN)
            pieces += [np.full(gap, 128, np.uint8), np.frombuffer(p, np.uint8)]
            place += gap + len(p)
        pieces.append(np.full(2 * FRAME * DOWN, 128, np.uint8))
        raw = np.concatenate(pieces)
        size = _CHUNK // DOWN * DOWN
        parts = []
        for k in range(0, len(raw), size):
            back = min(k, -(-TAPS // DOWN) * DOWN)
            parts.append(self.resample((raw[k - back : k + size].astype(np.float32) - 128) / 128)[back * UP // DOWN :])
        x = np.concatenate(parts)
        lengths = [-(-len(p) * UP // DOWN) for p in payloads]
        counts = [max(1, 1 + -(-(n - FRAME) // HOP)) for n in lengths]
        clean = np.zeros(sum((c - 1) * HOP + FRAME for c in counts), np.float32)  # no frame reaches into the next payload
        starts, to = [], 0
        for a, n, c in zip(at, lengths, counts, strict=True):
            clean[to : to + n] = x[a : a + n]
            starts.append(to + HOP * np.arange(c))
            to += (c - 1) * HOP + FRAME
        mels = self.log_mel(clean, np.concatenate([np.empty(0, np.int64), *starts]))
        out, done = [], 0
        for c in counts:
            out.append((*self._pack(mels[done : done + c]), c))
            done += c
        return out

    def _pack(self, mel: np.ndarray) -> tuple[bytes, list[dict]]:
        n = math.ceil(len(mel) / BLOCK)
        blocks = np.zeros((n, BLOCK, MELS), np.float32)
        blocks.reshape(-1, MELS)[: len(mel)] = mel
        start = np.arange(n) * BLOCK * self.hop_s
        end = (np.minimum(np.arange(1, n + 1) * BLOCK, len(mel)) - 1) * self.hop_s + self.frame_s
        table = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(blocks), pa.array(start), pa.array(end)], ["log_mel", "start_s", "end_s"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_batch(table)
        return sink.getvalue().to_pybytes(), [{"start_s": a * self.hop_s, "end_s": (b - 1) * self.hop_s + self.frame_s} for a, b in self.segments(mel).tolist()]


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The [blocks, block_frames, mels] tensor and the [blocks, 2] time spans of one document."""
    t = pa.ipc.open_stream(stream).read_all()
    spans = np.stack([t["start_s"].to_numpy(), t["end_s"].to_numpy()], axis=1)
    return t["log_mel"].combine_chunks().to_numpy_ndarray(), spans


def features(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> checks of the stored bytes, tensors (Arrow IPC), segments, n_frames."""

    def run(batches):
        lm = LogMel()
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments", "tensors"]
        for b in batches:
            sizes = np.array([len(m.as_buffer()) for m in b.column(2)])
            begin = 0
            while begin < b.num_rows:  # some hundred KB at a time
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), _CHUNK)))
                some = b.slice(begin, end - begin)
                media = some.column(2).to_pylist()
                payloads = [wav_payload(m) for m in media]
                found = lm.describe(payloads)
                cols = [
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([x[2] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), pa.array([x[0] for x in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *cols], names)
                begin = end

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments array<struct<start_s: double, end_s: double>>, tensors binary")
