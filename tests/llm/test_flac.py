import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tracemill.llm import flac


class Bits:
    """Writes bits, to build streams that the encoder never makes."""

    def __init__(self):
        self.out = ""

    def put(self, value, n):
        self.out += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.out += "0" * (u >> k) + "1"
        self.put(u & (1 << k) - 1, k)

    def done(self):
        text = self.out + "0" * (-len(self.out) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def stream(subframes, samples, channel=0, channels=1, bits=16):
    """One frame; ``subframes`` write their bits."""
    head = bytes([0xFF, 0xF8, 0b0111 << 4, channel << 4 | {8: 1, 16: 4}[bits] << 1, 0]) + (samples - 1).to_bytes(2, "big")
    w = Bits()
    for sub in subframes:
        sub(w)
    frame = head + bytes([flac.crc8(head)]) + w.done()
    frame += int(flac.crc16([frame])[0]).to_bytes(2, "big")
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | channels - 1 << 41 | bits - 1 << 36 | samples).to_bytes(8, "big")
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + bytes(16) + frame


def test_checksums():
    assert flac.crc8(b"123456789") == 0xF4
    assert [int(x) for x in flac.crc16([b"123456789", b"", b"\0\x01"])] == [0xFEE8, 0, 0x8005]


def test_lpc_partitions_and_escape():
    x = [100, 90, 95, 120, 80, 60, 75, 77]

    def lpc(w):
        w.put(0, 1), w.put(32 + 1, 6), w.put(0, 1)
        for v in x[:2]:
            w.put(v, 16)
        w.put(4, 4), w.put(1, 5), w.put(3, 5), w.put(-1, 5)  # 5-bit factors 3 and -1, shift 1
        w.put(0, 2), w.put(1, 4)  # two partitions
        e = [x[i] - ((3 * x[i - 1] - x[i - 2]) >> 1) for i in range(2, 8)]
        w.put(3, 4)
        for v in e[:2]:
            w.rice(v, 3)
        w.put(15, 4), w.put(9, 5)
        for v in e[2:]:
            w.put(v, 9)

    assert flac.decode(stream([lpc], 8)) == [x]


@pytest.mark.parametrize("channel", [1, 8, 9, 10])
def test_stereo(channel):
    a, b = [10, -20, 30, 7], [9, -25, 31, 7]
    side = [p - q for p, q in zip(a, b)]
    mid = [(p + q) >> 1 for p, q in zip(a, b)]
    pair = {1: (a, b), 8: (a, side), 9: (side, b), 10: (mid, side)}[channel]
    wide = {1: (16, 16), 8: (16, 17), 9: (17, 16), 10: (16, 17)}[channel]

    def sub(values, width):
        def write(w):
            w.put(1 << 1, 8)
            for v in values:
                w.put(v, width)

        return write

    assert flac.decode(stream([sub(v, n) for v, n in zip(pair, wide)], 4, channel, 2)) == [a, b]


def test_constant_wasted_bits_and_fixed_orders():
    def constant(w):
        w.put(1, 8), w.put(0b001, 3), w.put(-3, 13)  # three wasted bits

    assert flac.decode(stream([constant], 5)) == [[-24] * 5]
    x = [5, 9, 2, 4, 8, 1, 0, 3]
    for order, factors in enumerate(flac._FIXED):

        def fixed(w):
            w.put(8 + order << 1, 8)
            for v in x[:order]:
                w.put(v, 16)
            w.put(1, 2), w.put(0, 4), w.put(2, 5)
            for i in range(order, 8):
                w.rice(x[i] - sum(c * x[i - 1 - j] for j, c in enumerate(factors)), 2)

        assert flac.decode(stream([fixed], 8)) == [x]


def payloads():
    rng = random.Random(5)
    yield from (flac.payload_of(b"a" * n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 70_000))
    for n in (64, 960, 1024, 1088, 5000):
        yield flac.payload_of(bytes(rng.randrange(256) for _ in range(n)))
        yield flac.payload_of("".join(rng.choice("abc deé\n") for _ in range(n)).encode())


def test_round_trip_by_both_readers_and_seek():
    raw = list(payloads())
    streams = flac.encode_many(raw)
    assert flac.decode_many(streams) == raw
    for p, s in zip(raw, streams, strict=True):
        x = (np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8).tolist()
        assert flac.decode(s) == [x]
        at = len(x) // 2
        assert flac.seek(s, at, 40) == [x[at : at + 40]]
        assert [first for first, _ in flac.blocks(s)] == list(range(0, len(x), flac.BLOCK))


@pytest.mark.parametrize("n, prose", [(130, True), (2100, False)])
def test_many_frames(n, prose):
    """Frame numbers of two and of three bytes; seek points, blocks and both readers agree."""
    rng = random.Random(n)
    raw = "".join(rng.choice(["the ", "cat ", "sat, "] if prose else ["ab", "é "]) for _ in range(n * 300)).encode()
    raw = flac.payload_of((raw * 2)[: n * flac.BLOCK - 64])
    stream_ = flac.encode_many([raw])[0]
    info = flac.read_info(stream_)
    assert len(info.points) == n
    for i in (0, 127, 128, n - 1):
        at = info.first + info.points[i][1]
        assert flac.read_header(stream_, at, info)[4] == i * flac.BLOCK
    (found,) = flac.decode_blocks([stream_])
    assert [first for first, _ in found] == list(range(0, n * flac.BLOCK, flac.BLOCK))
    assert flac.decode_many([stream_]) == [raw]
    x = flac.samples_of(raw).tolist()
    for at in (128 * flac.BLOCK - 3, len(x) - 70):
        assert flac.seek(stream_, at, 40) == [x[at : at + 40]]


def test_coded_numbers():
    assert [flac._coded_number(n).hex() for n in (0, 127, 128, 2047, 2048, 65535, 65536)] == [
        "00", "7f", "c280", "dfbf", "e0a080", "efbfbf", "f0908080",
    ]


def kinds(stream_):
    info = flac.read_info(stream_)
    return [stream_[flac.read_header(stream_, info.first + p[1], info)[0]] >> 1 for p in info.points]


def test_fitted_predictors_are_used_where_smaller():
    wave = np.rint(60 * np.sin(np.arange(5000) * 0.7) + 30 * np.sin(np.arange(5000) * 1.9)).astype(np.int8)
    raw = flac.payload_of(flac.payload_from(wave.tobytes()))
    (coded,) = flac.encode_many([raw])
    assert set(kinds(coded)[:4]) == {32 + flac.ORDER - 1} and len(coded) < len(raw) // 2
    assert flac.decode(coded) == [flac.samples_of(raw).tolist()] and flac.decode_many([coded]) == [raw]
    assert 8 <= kinds(flac.encode_many([flac.payload_of(b"a" * 500)])[0])[0] <= 10


def test_damage_is_found():
    good = flac.encode_many([flac.payload_of(b"some text " * 300)])[0]
    for at in (5, len(good) // 2, len(good) - 1, len(good) - 400):
        bad = bytearray(good)
        bad[at if at > 5 else 30] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])


def brute(text):
    """The contracted columns of a text, sample by sample from the plain reader."""
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
    media = flac.encode_many([payload])[0]
    (x,) = flac.decode(media)
    assert [v + 128 for v in x] == list(payload)
    rms = int((sum(v * v for v in x) // len(x)) ** 0.5)
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    step = sum(abs(a - b) for a, b in zip(x, x[1:])) // (len(x) - 1)
    feature = f"rms={rms};zc={crossings};peak={max(map(abs, x))};step={step}"
    return (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
        hashlib.sha256(media).hexdigest(), feature,
    )


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_documents(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = flac.op9_flac(spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(docs[r.doc_id])


def test_very_long_text(spark):
    text = "".join(f"line {i} of a very long text, é\n" for i in range(100_000))
    (row,) = flac.stored_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    raw = text.encode()
    payload = flac.payload_of(raw)
    assert len(raw) > 3_000_000 and row.n_bytes == len(raw) and row.payload_bytes == len(payload)
    assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
    assert row.feature == flac.feature_of(payload)


def test_nulls_repeats_extra_columns_and_blocks(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType())])
    docs = spark.createDataFrame([(1, None, "x"), (None, "", None), (2, "é" * 1000, "x"), (2, "é" * 1000, "x")], schema)
    media = flac.text_media(docs)
    rows = sorted(flac.media_report(media).collect(), key=lambda r: r.n_bytes)
    assert [r.payload_bytes for r in rows] == [64, 64, 2048, 2048]
    assert rows[2][1:] == rows[3][1:] and rows[0][1:] == rows[1][1:]
    pcm = sorted((r.id or 0, r.sample_offset, r.samples, len(r.pcm)) for r in flac.pcm_blocks(media).collect())
    assert pcm == [(0, 0, 64, 64), (1, 0, 64, 64), (2, 0, 1024, 1024), (2, 0, 1024, 1024), (2, 1024, 1024, 1024), (2, 1024, 1024, 1024)]
    assert flac.media_report(flac.text_media(docs.limit(0))).collect() == []
