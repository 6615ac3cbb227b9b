"""Telephony audio columns: G.711 companding, ADPCM blocks and resampled PCM.

Payload bytes are stored as the 8-bit mu-law samples of a WAV file, which is lossless. Reading parses
the container, expands mu-law and A-law through 256-entry tables, decodes 64-byte IMA ADPCM blocks with
numpy across all blocks of a slice (the variant of the format that takes a difference as
((2 * code + 1) * step) >> 3), and resamples to PCM, which is stored in a table beside the other features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow, slices

UNIT = 64  # payloads are padded with zero bytes to a multiple of this, and it is the ADPCM block size
RATE = 8000

# Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def companding_tables() -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of every mu-law and every A-law byte."""
    byte = np.arange(256)
    u = ~byte & 0xFF
    t = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    mu = np.where(u & 0x80, 0x84 - t, t - 0x84)
    a = byte ^ 0x55
    part, t = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(part == 0, t + 8, (t + 0x108) << np.maximum(part - 1, 0))
    return mu.astype(np.int16), np.where(a & 0x80, size, -size).astype(np.int16)


MU_LAW, A_LAW = companding_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) of IMA ADPCM blocks given as rows of bytes: a 4-byte header, then nibbles, low first."""
    head = blocks[:, :4].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.clip(head[:, 2], 0, 88)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), dtype=np.int16)
    out[:, 0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * len(body)):
        code = (body[k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        move = ((2 * (code & 7).astype(np.int32) + 1) * step) >> 3
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX[code], 0, 88)
        out[:, k + 1] = value
    return out


def to_wav(payload: bytes, samples: int) -> bytes:
    """A mu-law WAV file; its fact chunk tells how many samples are not padding."""
    fmt = struct.pack("<HHIIHHH", 7, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(payload, samples that are not padding) of a mu-law WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if struct.unpack_from("<H", found[b"fmt "])[0] != 7:
        raise ValueError("not mu-law")
    return found[b"data"], struct.unpack("<I", found[b"fact"])[0]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, ends in slices(batches):
        raw, at = data.tobytes(), ends.tolist()
        media = []
        for a, b in zip(at, at[1:]):
            n = b - a
            media.append(to_wav(raw[a:b] + bytes((-n % UNIT) or (UNIT if n == 0 else 0)), n))
        yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], names=["doc_id", "media"])


def resample(samples: np.ndarray, first: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples at `rate`, each row's first): the mean of two at half the rate; at double the rate each sample and the mean with the row's next."""
    x = samples.astype(np.int32)
    if rate == RATE:
        return samples, first
    if 2 * rate == RATE:  # rows hold an even number of samples
        return ((x[0::2] + x[1::2]) >> 1).astype(np.int16), first // 2
    if rate == 2 * RATE:
        after = np.append(x[1:], 0)
        after[first[1:] - 1] = x[first[1:] - 1]
        out = np.empty(2 * len(x), dtype=np.int16)
        out[0::2], out[1::2] = x, (x + after) >> 1
        return out, first * 2
    raise ValueError(f"the rate must be {RATE // 2}, {RATE} or {2 * RATE}")


def _reader(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64)
            part = np.cumsum(sizes) >> 21  # about 2 MB at one time
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                yield _features(batch.slice(int(rows[0]), len(rows)), rate)

    return run


def _features(batch: pa.RecordBatch, rate: int) -> pa.RecordBatch:
    media = batch.column(1).to_pylist()
    read = [from_wav(x) for x in media]
    codes = np.frombuffer(b"".join(p for p, _ in read), dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum([len(p) for p, _ in read])))
    at, n = first[:-1], np.diff(first)
    mu, al = MU_LAW[codes], A_LAW[codes]
    energy = lambda x: np.add.reduceat(x.astype(np.int64) ** 2, at)
    cross = np.zeros(len(codes), dtype=np.int64)
    cross[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    cross[at] = 0
    crossings = np.add.reduceat(cross, at)
    adpcm = decode_adpcm(codes.reshape(-1, UNIT))
    peak = np.maximum.reduceat(np.abs(adpcm.astype(np.int32)).max(axis=1), at // UNIT)
    pcm, start = resample(mu, first, rate)
    raw, blocks = np.ascontiguousarray(pcm, dtype="<i2").tobytes(), np.ascontiguousarray(adpcm, dtype="<i2").tobytes()
    width = 2 * adpcm.shape[1]
    e_mu, e_al = energy(mu), energy(al)
    out = []
    for i, ((payload, samples), m) in enumerate(zip(read, media, strict=True)):
        a, b = int(first[i]), int(first[i + 1])
        coded = zlib.crc32(blocks[a // UNIT * width : b // UNIT * width])
        feature = f"mu={int(e_mu[i]) // int(n[i])},a={int(e_al[i]) // int(n[i])},zc={int(crossings[i])},peak={int(peak[i])},adpcm={coded:08x}"
        out.append((samples, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature, raw[2 * int(start[i]) : 2 * int(start[i + 1])]))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*out, strict=True))], names=["doc_id", *names])


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes, padded, as a mu-law WAV file in a table of the shared folder."""
    rows = narrow(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(_write, f"doc_id {kind}, media binary"), "media", level=9)


def read_audio(media: DataFrame, rate: int = RATE // 2) -> DataFrame:
    """Payload digests, features and resampled PCM of stored files (doc_id, media); the PCM is stored, and its digest taken from what is read back.

    Null texts were stored as empty ones (64 zero bytes). Null and repeated ids pass through, each row by
    itself; columns other than the two are not read, whatever their names; an empty table gives no rows. Equal
    texts have equal values. Files of any length are decoded whole, about 2 MB of them at one time. `rate` is half, all or double of
    the telephone rate. `pcm` holds little-endian 16-bit samples.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    stored = materialize(media.select("doc_id", "media").mapInArrow(_reader(rate), schema), "pcm", level=9)
    return stored.withColumn("feature", F.format_string(f"%s,pcm{rate}=%08x", "feature", F.crc32("pcm")))
