"""Media columns: telephony audio (mu-law, A-law, IMA ADPCM) in WAV files held in a binary column.

Mu-law and A-law samples expand by lookup tables of 256 entries, made from their rule. ADPCM blocks
are decoded by numpy across blocks, of all files of a batch: step k of all blocks at once, since blocks are
independent. Decoded audio is resampled by a windowed-sinc polyphase filter and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import pieces, small_batches, stored

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17

# fixed values: the step sizes of IMA ADPCM, and the index changes by the low three bits of a code
IMA_STEP = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent == 0, low, (low + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of a 4-byte header (first sample, step index) and codes, low half first.

    A last block that is shorter is decoded by itself; a rest of under 4 bytes holds no sample.
    """
    whole = len(data) // block
    parts = [np.frombuffer(data, np.uint8, whole * block).reshape(whole, block)] if whole else []
    if len(data) - whole * block >= 4:
        parts.append(np.frombuffer(data, np.uint8, offset=whole * block)[None, :])
    return np.concatenate([_decode_blocks(p).ravel() for p in parts]) if parts else np.zeros(0, np.int16)


def _decode_blocks(blocks: np.ndarray) -> np.ndarray:
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEP) - 1)
    codes = np.empty((len(blocks), 2 * (blocks.shape[1] - 4)), np.int32)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k], IMA_STEP[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, len(IMA_STEP) - 1)
        out[:, k + 1] = value
    return out


def wav(samples: bytes, kind: int = MULAW, rate: int = 8000, block: int = 1, note: bytes = b"") -> bytes:
    """A mono RIFF file; note goes into a chunk of its own."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA: 4}[kind]
    width = {PCM: 2, IMA: block}.get(kind, 1)
    per_second = rate * width if kind != IMA else rate * block // (2 * (block - 4) + 1)
    form = struct.pack("<HHIIHH", kind, 1, rate, per_second, width, bits)
    chunks = b"".join(
        name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        for name, body in ((b"fmt ", form), *([(b"note", note)] if note else []), (b"data", samples))
    )
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def read_wav(data: bytes) -> dict:
    """kind, rate, block, data and note of a mono file; ValueError for anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        found[name] = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("no fmt or data chunk")
    kind, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or kind not in (PCM, ALAW, MULAW, IMA):
        raise ValueError(f"format {kind} with {channels} channels")
    return {"kind": kind, "rate": rate, "block": block, "data": found[b"data"], "note": found.get(b"note", b"")}


#: Blocks that are decoded at once, and samples that are looked at at once.
SLAB, CHUNK = 1 << 14, 1 << 18


def samples_of(files: list[dict]) -> list[np.ndarray]:
    """16-bit samples of what read_wav returned, file by file. ADPCM blocks of equal size are decoded together."""
    out: list[np.ndarray] = [None] * len(files)
    whole: dict[int, list[int]] = {}
    for i, file in enumerate(files):
        kind, data = file["kind"], file["data"]
        if kind == PCM:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        elif kind != IMA:
            out[i] = _TABLES[kind][np.frombuffer(data, np.uint8)]
        elif len(data) % file["block"] or not data:
            out[i] = decode_ima(data, file["block"])
        else:
            whole.setdefault(file["block"], []).append(i)
    for block, some in whole.items():
        every = np.frombuffer(b"".join([files[i]["data"] for i in some]), np.uint8).reshape(-1, block)
        decoded = np.concatenate([_decode_blocks(every[a : a + SLAB]) for a in range(0, len(every), SLAB)])
        cuts = np.cumsum([len(files[i]["data"]) // block for i in some])[:-1]
        for i, own in zip(some, np.split(decoded, cuts), strict=True):
            out[i] = own.ravel()
    return out


_filters: dict[tuple[int, int], np.ndarray] = {}


def _filter(up: int, down: int, taps: int = 16) -> np.ndarray:
    if (up, down) not in _filters:
        cut = min(1.0, up / down)
        at = np.arange(taps) - (taps // 2 - 1)
        rows = []
        for phase in range(up):
            x = at - phase / up
            window = np.where(np.abs(x) <= taps / 2, 0.5 + 0.5 * np.cos(2 * np.pi * x / taps), 0)
            h = np.sinc(cut * x) * cut * window
            rows.append(h / h.sum())
        _filters[up, down] = np.array(rows, np.float32)
    return _filters[up, down]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate, by a polyphase windowed sinc; ends are padded with zero."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    g = gcd(rate, to)
    up, down = to // g, rate // g
    h = _filter(up, down)
    taps = h.shape[1]
    x = np.concatenate((np.zeros(taps // 2 - 1, np.float32), pcm.astype(np.float32), np.zeros(taps // 2 + 1, np.float32)))
    out = np.empty(-(-len(pcm) * up // down), np.int16)
    seen = np.lib.stride_tricks.sliding_window_view(x, taps)
    for first in range(min(up, len(out))):
        start, place = first * down // up, out[first::up]
        # each phase's windows are taken in chunks: numpy would copy those of a long sound all at once
        for a in range(0, len(place), CHUNK):
            b = min(a + CHUNK, len(place))
            y = seen[start + down * a : start + down * (b - 1) + 1 : down] @ h[first * down % up]
            place[a:b] = np.clip(np.rint(y), -32768, 32767)
    return out


def feature(pcm: np.ndarray) -> str:
    """Length, root mean square, peak, zero crossings and CRC-32 of 16-bit samples."""
    power = peak = 0
    for a in range(0, len(pcm), CHUNK):
        wide = pcm[a : a + CHUNK].astype(np.int64)
        power += int(np.dot(wide, wide))
        peak = max(peak, int(np.abs(wide).max()))
    rms = int(np.sqrt(power // max(1, len(pcm))))
    turns = int(np.count_nonzero(np.diff(pcm >= 0)))
    return f"n={len(pcm)};rms={rms};peak={peak};turns={turns};crc={zlib.crc32(np.ascontiguousarray(pcm, '<i2')):08x}"


def decode_column(media: DataFrame, id_column: str, media_column: str = "media", to: int = 16000) -> DataFrame:
    """Decodes a binary column of WAV files: id_column, kind, rate, n_samples, pcm (16-bit little-endian at
    rate to), feature and error.

    A file that can't be read, or a null, has null results and the reason in error; the row stays.
    Other columns are ignored; repeated rows give a row each; an empty data chunk gives empty pcm.
    """
    small_batches(media.sparkSession)
    id_type = media.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "media", 1 << 20):
                rows, files = [], []
                for data in batch.column("media").to_pylist():
                    try:
                        files.append(read_wav(data or b""))
                        rows.append(None)
                    except ValueError as e:
                        rows.append((None, None, None, None, None, str(e)))
                made = iter(zip(files, samples_of(files), strict=True))
                for i, row in enumerate(rows):
                    if row is None:
                        file, pcm = next(made)
                        pcm = resample(pcm, file["rate"], to)
                        rows[i] = (file["kind"], file["rate"], len(pcm), pcm.astype("<i2").tobytes(), feature(pcm), None)
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=[id_column, "kind", "rate", "n_samples", "pcm", "feature", "error"],
                )

    schema = f"{id_column} {id_type}, kind int, rate int, n_samples long, pcm binary, feature string, error string"
    return media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media")).mapInArrow(run, schema)


#: Bytes of payload in an ADPCM block, and the header that each begins with: first sample 0, step index 16.
BODY, HEADER = 64, bytes([0, 0, 16, 0])


def payload_file(raw: bytes) -> bytes:
    """A sound file that holds raw without loss, padded with zero bytes to a positive multiple of 64; the file notes the
    unpadded length. The payload's CRC-32 says whether it is mu-law or A-law samples, or the codes of ADPCM blocks."""
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    note = struct.pack("<Q", len(raw))
    kind = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]
    if kind != IMA:
        return wav(payload, kind, note=note)
    blocks = np.empty((len(payload) // BODY, len(HEADER) + BODY), np.uint8)
    blocks[:, : len(HEADER)] = np.frombuffer(HEADER, np.uint8)
    blocks[:, len(HEADER) :] = np.frombuffer(payload, np.uint8).reshape(-1, BODY)
    return wav(blocks.tobytes(), IMA, block=blocks.shape[1], note=note)


def payload_of(file: dict) -> tuple[bytes, int]:
    """(payload, its unpadded length) of what read_wav returned for a payload_file()."""
    data = file["data"]
    if file["kind"] == IMA:
        data = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, file["block"])[:, len(HEADER) :]).tobytes()
    return data, struct.unpack("<Q", file["note"])[0]


def store_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes as a sound file (see payload_file), written to the shared folder.

    A null text is empty. Returns id_column and media, read from what was written. Repeated rows give a row each and
    equal texts equal files; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                files = [payload_file((text or "").encode()) for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(files, pa.binary())], names=[id_column, "media"])

    made = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"{id_column} {id_type}, media binary")
    return stored(made, "media")


def describe_bytes(media: DataFrame, id_column: str = "doc_id", to: int = 4000) -> DataFrame:
    """Of stored files, read back: n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 payload bytes),
    media_bytes, media_sha256, codec (mulaw, alaw or ima), pcm (the decoded audio as 16-bit samples at rate to) and feature, of
    pcm. Rows as in store_bytes(); a null media fails, as store_bytes() makes none."""
    small_batches(media.sparkSession)
    id_type = media.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for whole in batches:
            for batch in pieces(whole, "media", 1 << 20):
                rows = []
                every = batch.column("media").to_pylist()
                files = [read_wav(data) for data in every]
                for data, file, pcm in zip(every, files, samples_of(files), strict=True):
                    payload, n = payload_of(file)
                    pcm = resample(pcm, file["rate"], to)
                    sha = hashlib.sha256
                    codec = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima"}[file["kind"]]
                    rows.append((n, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), sha(data).hexdigest(), feature(pcm), codec, pcm.astype("<i2").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, zip(*rows, strict=True))], names=names)

    return media.select(F.col(id_column).alias("id"), "media").mapInArrow(run, schema)
