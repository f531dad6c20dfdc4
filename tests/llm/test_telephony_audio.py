import hashlib
import math
import random
import struct
import zlib

import numpy as np

from lattica.llm import telephony_audio as T

from . import cases


def test_tables_have_the_known_values():
    mu, a = T.mulaw_table(), T.alaw_table()
    assert mu[0x00] == -32124 and mu[0x80] == 32124 and mu[0x7F] == 0 and mu[0xFF] == 0 and mu[0xF0] == 120
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(T.IMA_STEP) == 89


def slow_ima(data, predictor, index):
    out = []
    for byte in data:
        for n in (byte & 15, byte >> 4):
            step = int(T.IMA_STEP[index])
            move = step >> 3
            move += step * (n >> 2 & 1) + (step >> 1) * (n >> 1 & 1) + (step >> 2) * (n & 1)
            predictor = max(-32768, min(32767, predictor - move if n & 8 else predictor + move))
            index = max(0, min(88, index + int(T.IMA_INDEX[n])))
            out.append(predictor)
    return out


def test_blocks_decode_as_one_by_one():
    rng = np.random.default_rng(6)
    data, p, i = rng.integers(0, 256, (7, 40), dtype=np.uint8), rng.integers(-3000, 3000, 7), rng.integers(0, 89, 7)
    got = T.decode_blocks(data, p, i)
    assert [list(r) for r in got] == [slow_ima(data[k].tolist(), int(p[k]), int(i[k])) for k in range(7)]


def test_round_trip_of_every_codec():
    rng = random.Random(7)
    for codec in T.NAMES:
        for n in (192, 384, 1920):
            payload = rng.randbytes(n)
            tag, _, blocks = T.opened(T.stored(payload, codec))
            assert tag == codec and T.payload_of(tag, blocks) == payload


def test_wav_is_readable_as_a_riff_file():
    media = T.stored(b" " * 192, T.MULAW)
    assert int.from_bytes(media[4:8], "little") == len(media) - 8


def plain_pcm(media):
    """Format tag and PCM of a WAV file, chunk by chunk and sample by sample."""
    chunks, at = {}, 12
    while at < len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    assert (channels, rate) == (1, 8000) and bits == (4 if tag == 17 else 8)
    out, data = [], chunks[b"data"]
    if tag == 17:
        per_block = struct.unpack_from("<H", chunks[b"fmt "], 18)[0]
        for k in range(0, len(data), align):
            first = int.from_bytes(data[k : k + 2], "little", signed=True)
            block = [first, *slow_ima(data[k + 4 : k + align], first, data[k + 2])]
            assert len(block) == per_block
            out += block
    for b in data if tag == 7 else b"":
        b = ~b & 255
        size = ((b & 15) * 2 + 33 << (b >> 4 & 7)) - 33 << 2
        out.append(-size if b & 128 else size)
    for b in data if tag == 6 else b"":
        b ^= 0x55
        e, m = b >> 4 & 7, b & 15
        size = (m * 16 + 8) if e == 0 else (m * 16 + 264) * 2 ** (e - 1)
        out.append(size if b & 128 else -size)
    assert int.from_bytes(chunks[b"fact"], "little") == len(out)
    return tag, out


def test_query_rows_by_plain_decoding(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = T.op9_telephony_audio(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r.doc_id]
        payload = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text), len(payload), zlib.crc32(payload[-16:])) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        if len(payload) > 6000:
            continue  # slow by hand
        tag, pcm = plain_pcm(bytes(r.media))
        ahead = pcm[1:] + pcm[-1:]
        twice = [v for a, b in zip(pcm, ahead, strict=True) for v in (a, (a + b) // 2)]
        assert struct.pack(f"<{len(twice)}h", *twice) == bytes(r.pcm)
        rms = math.isqrt(sum(v * v for v in twice) // len(twice))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(twice, twice[1:], strict=False))
        assert r.feature == f"codec={T.NAMES[tag]};rate=16000;samples={len(twice)};rms={rms};peak={max(map(abs, twice))};crossings={crossings};pcm_crc32={zlib.crc32(bytes(r.pcm))}"


def test_resampling():
    assert T.resampled(np.array([0, 10, -10], dtype=np.int16)).tolist() == [0, 5, 10, 0, -10, -10]
    assert len(T.resampled(np.arange(80, dtype=np.int16), 8000, 11025)) == 110 and len(T.resampled(np.zeros(0, np.int16))) == 0


def test_awkward_documents(spark):
    docs = cases.documents(spark)
    rows = T.audio(docs).collect()
    want = sorted([(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()], key=str)
    assert len(rows) == len(want)
    by_payload = {}
    for r in rows:
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes)
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        codec, _, blocks = T.opened(bytes(r.media))
        payload = T.payload_of(codec, blocks)
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 and zlib.crc32(payload[-16:]) == r.tail_crc32
        assert f"samples={len(r.pcm) // 2};" in r.feature
        assert by_payload.setdefault(payload, r.feature) == r.feature
    assert sorted([(r.doc_id, r.n_bytes) for r in rows], key=str) == sorted([(i, len(t)) for i, t in want], key=str)
    assert {f.split(";")[0] for f in by_payload.values()} == {"codec=mulaw", "codec=alaw", "codec=ima_adpcm"}
    assert T.audio(cases.empty(spark)).collect() == []
