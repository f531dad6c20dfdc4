"""Telephony audio as media columns.

``stored`` puts bytes losslessly into a WAV file as mu-law or A-law samples or as the
nibbles of IMA ADPCM blocks (mono, 8 kHz); ``opened`` parses such a file. Mu-law and
A-law expand by lookup tables of 256 entries, built by rule. ADPCM decodes with numpy
across blocks: step k of all blocks of a batch at once, so the sequential part is the
length of one block whatever the number of blocks. PCM is resampled to 16 kHz.

Defined results: a null text is an empty payload, padded to one unit; equal payloads get
equal values, as codec and features depend on the payload alone; rows with null ids and
repeated rows are rows like others; other columns are ignored; an empty table gives an
empty result. Long texts are decoded in slices of a fixed number of blocks; the query keeps
digests alone and takes texts up to the 2 GB of a value, while the columns of media and PCM
(9 bytes and less for a byte of text) fit in a value for texts of up to 200 MB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_arrow

UNIT, PAD = 192, b" "
RATE, RESAMPLED = 8000, 16000
#: WAV format tags.
ALAW, MULAW, IMA = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima_adpcm"}
#: Blocks decoded at once, and bytes of text handled at once.
BLOCKS, HELD = 16_384, 4 << 20

# Fixed values of the IMA ADPCM format.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
IMA_STEP = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM of every mu-law byte (G.711): inverted bits, sign, 3-bit segment, 4-bit step, bias 132."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of every A-law byte (G.711): even bits inverted, sign set for positive, 3-bit segment, 4-bit step."""
    a = np.arange(256) ^ 0x55
    part, segment = (a & 15) << 4, (a >> 4) & 7
    size = np.where(segment == 0, part + 8, (part + 264) << np.maximum(segment - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_blocks(data: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> np.ndarray:
    """IMA ADPCM: ``data`` (blocks, bytes) uint8 to PCM (blocks, 2 x bytes), low nibble first."""
    out = np.empty((data.shape[1] * 2, len(data)), dtype=np.int16)
    value, at = predictor.astype(np.int32), index.astype(np.int32)
    columns = np.ascontiguousarray(data.T)
    for k in range(len(out)):
        nibble = columns[k >> 1] >> 4 if k & 1 else columns[k >> 1] & 15
        step = IMA_STEP[at]
        move = step >> 3
        move = move + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
        at = np.clip(at + IMA_INDEX[nibble], 0, 88)
        out[k] = value
    return out.T


def resampled(pcm: np.ndarray, rate: int = RATE, to: int = RESAMPLED) -> np.ndarray:
    """Linear interpolation; a whole multiple of the rate, the usual case, needs no index arithmetic."""
    if to % rate == 0 and len(pcm):
        k = to // rate
        x = pcm.astype(np.int32)
        ahead = np.append(x[1:], x[-1:])
        return ((x[:, None] * np.arange(k, 0, -1) + ahead[:, None] * np.arange(k)) // k).astype(np.int16).ravel()
    return np.interp(np.arange(len(pcm) * to // rate) * (rate / to), np.arange(len(pcm)), pcm).astype(np.int16) if len(pcm) else pcm


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + PAD * (max(1, -(-len(text) // unit)) * unit - len(text))


def stored(payload: bytes, codec: int, unit: int = UNIT) -> bytes:
    """The WAV file that holds ``payload`` in its samples."""
    if codec == IMA:  # every block: its first sample 0, index 0, then its nibbles
        body = b"".join(b"\0\0\0\0" + payload[i : i + unit] for i in range(0, len(payload), unit))
        align, bits, extra = unit + 4, 4, struct.pack("<HH", 2, 2 * unit + 1)
        per_second = RATE * align // (2 * unit + 1)
    else:
        body, align, bits, extra, per_second = payload, 1, 8, struct.pack("<H", 0), RATE
    samples = len(body) // align * (2 * unit + 1) if codec == IMA else len(payload)
    fmt = struct.pack("<HHIIHH", codec, 1, RATE, per_second, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def opened(media: bytes) -> tuple[int, int, np.ndarray]:
    """Format tag, block size and the data chunk as (blocks, block size) uint8."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, align = 12, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            return codec, align, np.frombuffer(media, dtype=np.uint8, count=size, offset=at + 8).reshape(-1, align)
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(codec: int, blocks: np.ndarray) -> bytes:
    """The bytes that ``stored`` was given."""
    return (blocks[:, 4:] if codec == IMA else blocks).tobytes()


def decoded(files: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """PCM of each (format tag, blocks); the ADPCM blocks of all files are decoded together."""
    out: list = [None if codec == IMA else _TABLES[codec][blocks.ravel()] for codec, blocks in files]
    ima = [i for i, (codec, _) in enumerate(files) if codec == IMA]
    if not ima:
        return out
    every = np.concatenate([files[i][1] for i in ima])
    predictor, index = every[:, :2].copy().view("<i2").ravel(), np.minimum(every[:, 2], 88)
    pcm = np.concatenate([decode_blocks(every[at : at + BLOCKS, 4:], predictor[at : at + BLOCKS], index[at : at + BLOCKS]) for at in range(0, len(every), BLOCKS)])
    pcm = np.hstack([predictor[:, None], pcm])  # a block's header is its first sample
    ends = np.cumsum([len(files[i][1]) for i in ima])
    for i, part in zip(ima, np.split(pcm, ends[:-1]), strict=True):
        out[i] = part.ravel()
    return out


def features(codec: int, pcm: np.ndarray) -> str:
    """Of the resampled PCM: samples, root mean square, peak, zero crossings and CRC-32."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt(np.dot(x, x) / len(x))) if len(x) else 0
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"codec={NAMES[codec]};rate={RESAMPLED};samples={len(pcm)};rms={rms};peak={int(np.abs(x).max()) if len(x) else 0};crossings={crossings};pcm_crc32={zlib.crc32(pcm.tobytes())}"


def codec_of(payload: bytes) -> int:
    """The format that a payload is stored in, by its CRC-32."""
    return (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def audio(docs: DataFrame, unit: int = UNIT, media: bool = True, pcm: bool = True) -> DataFrame:
    """Digests of every document's stored form, and on request the form itself (``media``)
    and its resampled PCM (``pcm``, little-endian 16 bits)."""
    schema = DIGEST + ", media binary" * media + ", pcm binary" * pcm

    def rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        payloads = [padded(t, unit) for t in texts]
        files = [stored(p, codec_of(p), unit) for p in payloads]
        del payloads
        back = [opened(f) for f in files]
        again = [payload_of(codec, blocks) for codec, _, blocks in back]
        sound = [resampled(x) for x in decoded([(codec, blocks) for codec, _, blocks in back])]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "payload_bytes": pa.array([len(p) for p in again], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in again], pa.string()),
            "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in again], pa.int64()),
            "media_bytes": pa.array([len(f) for f in files], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
            "feature": pa.array([features(codec, x) for (codec, _, _), x in zip(back, sound, strict=True)], pa.string()),
        }
        if media:
            columns["media"] = pa.array(files, pa.binary())
        if pcm:
            columns["pcm"] = pa.array([x.astype("<i2").tobytes() for x in sound], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                held += len(texts[-1]) + unit
                if held >= HELD:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, schema)


def op9_telephony_audio(spark, sf_dir: str) -> DataFrame:
    """Every document through its stored audio form and back, with the form and its resampled PCM as columns."""
    return audio(spark.read.parquet(f"{sf_dir}/documents.parquet"))
