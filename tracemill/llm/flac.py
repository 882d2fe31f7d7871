"""FLAC media columns: encoding, verified decoding and seekable blocks of PCM.

``encode_many`` writes mono 8-bit streams whose blocks of 1024 samples use the best fixed linear
predictor of order 0 to 2, or a linear predictor of order 8 fitted to the block where that is smaller,
and Rice-coded residuals, with a seek point for every frame.  ``decode_blocks`` reads such streams back
in vectorised steps over many frames at once: the frames' checksums are verified, the ends of the unary
parts are followed in all frames together, fixed predictors are undone by cumulative sums and the others
sample by sample in all frames.  ``decode`` reads any FLAC stream (constant, verbatim, fixed and LPC
subframes, escaped partitions, wasted bits, stereo decorrelation, up to 32 bits); the fast reader leaves
frames that it was not made for to it.  ``seek`` decodes from a sample on.

``text_media`` makes the media column, ``pcm_blocks`` turns it into blocks of PCM with the offsets of
their first samples, and ``media_report`` puts blocks together again.  The query stores the streams as a
table, reads that back and takes all it returns from the blocks.

Frames are handled in groups of ``LANES``, so what is held at a time beside a stream and its samples is
bounded also for very long texts.

Nulls: a null text or stream is empty.  Equal texts give equal values; repeated rows give repeated
results, in no order of their own.  Columns are selected by name and renamed, so extra ones may have any
name.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import ship_package

from . import textkit as tk
from .shared import Workspace, arrow_map, batch_of, map_batches, table

BLOCK, LANES, RATE, PAD = 1024, 512, 8000, 64
ZERO = 0x80
#: Order of fitted predictors, bits of a factor with its sign, and the shift that undoes their scale.
ORDER, PRECISION, SHIFT = 8, 10, 8


class FlacError(ValueError):
    pass


def samples_of(payload: bytes) -> np.ndarray:
    """Signed samples of bytes; ``ZERO`` is the byte of silence."""
    return (np.frombuffer(payload, np.uint8) - np.uint8(ZERO)).view(np.int8)


def payload_from(pcm: bytes) -> bytes:
    return (np.frombuffer(pcm, np.uint8) + np.uint8(ZERO)).tobytes()


@cache
def _crc16_table() -> np.ndarray:
    """For each 16-bit word, the state after it (polynomial 0x8005, from state 0)."""
    state = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        state = (state << 1 ^ np.where(state & 0x8000, 0x8005, 0)) & 0xFFFF
    return state.astype(np.uint16)


def crc16(frames: list[bytes]) -> np.ndarray:
    """Frame checksums, all frames in step; leading zeros do not change a state of 0."""
    if not frames:
        return np.zeros(0, np.uint16)
    width = max(map(len, frames)) + 1 & ~1
    flat = np.frombuffer(b"".join(f.rjust(width, b"\0") for f in frames), ">u2").reshape(len(frames), -1)
    words, step = np.ascontiguousarray(flat.T).astype(np.uint16), _crc16_table()
    state = np.zeros(len(frames), np.uint16)
    for word in words:
        state = step[state ^ word]
    return state


@cache
def _crc8_table() -> bytes:
    out = []
    for state in range(256):
        for _ in range(8):
            state = (state << 1 ^ (0x07 if state & 0x80 else 0)) & 0xFF
        out.append(state)
    return bytes(out)


def crc8(data: bytes) -> int:
    """Header checksum (polynomial 0x07, from state 0)."""
    state, step = 0, _crc8_table()
    for byte in data:
        state = step[state ^ byte]
    return state


def _coded_number(n: int) -> bytes:
    """UTF-8 style coding of a frame or sample number of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x3F
    while n > limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([0xFF ^ limit * 2 + 1 | n, *reversed(tail)])


@lru_cache(1 << 16)
def _header(number: int, samples: int) -> bytes:
    """Header of a mono 8-bit frame at 8 kHz, checksum included."""
    if samples == BLOCK:
        kind, extra = 0b1010, b""
    elif samples <= 256:
        kind, extra = 0b0110, bytes([samples - 1])
    else:
        kind, extra = 0b0111, (samples - 1).to_bytes(2, "big")
    head = bytes([0xFF, 0xF8, kind << 4 | 0b0100, 0b0001 << 1]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


def _predictors(x: np.ndarray) -> np.ndarray:
    """Factors of order ``ORDER`` for each row, in units of 2**-SHIFT, by Levinson's recursion."""
    y = x.astype(np.float64)
    r = np.stack([(y[:, j:] * y[:, : y.shape[1] - j]).sum(1) for j in range(ORDER + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-6) + 1e-3
    factors, error = np.zeros((len(y), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (factors[:, :i] * r[:, i:0:-1]).sum(1)) / error
        factors[:, :i] -= k[:, None] * factors[:, :i][:, ::-1].copy()
        factors[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(factors * (1 << SHIFT)), -most - 1, most).astype(np.int32)


def _rice(e: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsigned residuals, the parameter of each row, and the bits that its residuals take."""
    u = np.where(coded, e << 1 ^ e >> 31, 0)
    count = coded.sum(1)
    mean = u.sum(1) / np.maximum(count, 1)
    k = np.clip(np.ceil(np.log2(np.maximum(mean * math.log(2), 1e-9))), 0, 14).astype(np.int64)
    return u, k, (u >> k[:, None]).sum(1) + count * (k + 1)


def _encode_group(blocks: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Frames of up to ``LANES`` blocks of signed samples."""
    n = np.array([len(b) for b in blocks])
    width = int(n.max())
    x = np.zeros((len(blocks), width), np.int32)
    valid = np.arange(width) < n[:, None]
    x[valid] = np.concatenate(blocks)
    best, cost, order = x, np.where(valid, np.abs(x), 0).sum(1), np.zeros(len(n), np.int64)
    e = x
    for o in (1, 2):
        e = np.diff(e, axis=1, prepend=0)
        own = np.where(valid & (np.arange(width) >= o), np.abs(e), 0).sum(1)
        better = (own < cost) & (n > o)
        best, cost, order = np.where(better[:, None], e, best), np.where(better, own, cost), np.where(better, o, order)
    coded = valid & (np.arange(width) >= order[:, None])
    u, k, size = _rice(best, coded)
    side = np.zeros(len(n), np.int64)  # bits between the warm-up samples and the residual
    factors = _predictors(x)
    guess = np.zeros_like(x)
    for j in range(ORDER):
        guess[:, j + 1 :] += factors[:, j : j + 1] * x[:, : -j - 1]
    fitted = valid & (np.arange(width) >= ORDER)
    u2, k2, size2 = _rice(x - (guess >> SHIFT), fitted)
    more = 9 + ORDER * PRECISION
    fit = (n > ORDER) & (size2 + more + 8 * ORDER < size + 8 * order)
    u, k, order = np.where(fit[:, None], u2, u), np.where(fit, k2, k), np.where(fit, ORDER, order)
    side, coded = np.where(fit, more, 0), np.where(fit[:, None], fitted, coded)
    count = coded.sum(1)
    q = u >> k[:, None]
    size = np.where(coded, q + 1 + k[:, None], 0)
    heads = [_header(i, int(m)) for i, m in zip(numbers, n, strict=True)]
    warm_end = np.array([len(h) for h in heads]) * 8 + 8 + 8 * order
    lead = warm_end + side  # bits before the residual's header
    bits = lead + 10 + size.sum(1)
    whole = (bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(whole)])
    first = base[:-1] * 8 + lead + 10
    at = (first[:, None] + np.cumsum(size, 1) - size)[coded]
    q, u = q[coded], u[coded]
    out = np.zeros(int(base[-1]) * 8, np.uint8)
    out[at + q] = 1
    rice = np.repeat(k, count)
    for b in range(int(k.max())):
        if (k > b).all():
            out[at + q + rice - b] = u >> b & 1
        else:
            some = rice > b
            out[(at + q + rice - b)[some]] = u[some] >> b & 1
    for b in range(4):  # two bits of method and four of partition order stay zero
        out[first - 4 + b] = k >> 3 - b & 1
    own = np.flatnonzero(fit)
    if len(own):  # precision less one, shift and factors
        values = np.column_stack([np.full(len(own), PRECISION - 1), np.full(len(own), SHIFT), factors[own]])
        spot = base[:-1][own] * 8 + warm_end[own]
        for j, wide in enumerate([4, 5, *[PRECISION] * ORDER]):
            for b in range(wide):
                out[spot + b] = values[:, j] >> wide - 1 - b & 1
            spot = spot + wide
    data = np.packbits(out)
    frames = []
    for i, (head, o, fitted_) in enumerate(zip(heads, order.tolist(), fit.tolist(), strict=True)):
        frame = bytearray(data[base[i] : base[i + 1]].tobytes())
        warm = (blocks[i][:o] & 0xFF).astype(np.uint8).tobytes()
        kind = 32 + o - 1 if fitted_ else 8 + o
        frame[: len(head) + 1 + o] = head + bytes([kind << 1]) + warm
        frames.append(bytes(frame))
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc16(frames), strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of signed 8-bit samples (byte minus 128) for each payload of at least one byte."""
    blocks, numbers, owner = [], [], []
    for i, payload in enumerate(payloads):
        samples = samples_of(payload)
        for j in range(0, len(samples), BLOCK):
            blocks.append(samples[j : j + BLOCK].astype(np.int32))
            numbers.append(j // BLOCK)
            owner.append(i)
    frames: list[list[bytes]] = [[] for _ in payloads]
    for j in range(0, len(blocks), LANES):
        for i, frame in zip(owner[j:], _encode_group(blocks[j : j + LANES], numbers[j : j + LANES]), strict=False):
            frames[i].append(frame)
    return [_stream(p, f) for p, f in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    block = BLOCK if len(payload) > BLOCK else max(16, len(payload))
    digest = hashlib.md5(samples_of(payload).tobytes()).digest()
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest
    points, at = [], 0
    for i, size in enumerate(sizes):
        points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(payload) - i * BLOCK)))
        at += size
    # a seek table holds 932067 points at most; longer streams keep every second, fourth ... point
    while 18 * len(points) >= 1 << 24:
        points = points[::2]
    seek = b"".join(points)
    head = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
    return b"".join([head, *frames])


@dataclass
class Info:
    """STREAMINFO, the seek points (first sample, offset of the frame, samples) and where frames begin."""

    block_min: int
    block_max: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]]
    first: int


def read_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata is cut short")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            lo, hi = struct.unpack(">HH", body[:4])
            info = (lo, hi, word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
    if info is None:
        raise FlacError("no stream information")
    return Info(*info, points, at)


_SIZES = {1: 192, **{i: 576 << i - 2 for i in range(2, 6)}, **{i: 256 << i - 8 for i in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def read_header(data: bytes, at: int, info: Info) -> tuple[int, int, int, int, int]:
    """(end of the header, samples, channel code, bits, first sample) of the frame at ``at``."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should begin")
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    channel, bits = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (1 << 6 - more) - 1
    for byte in data[at + 5 : at + 5 + more]:
        number = number << 6 | byte & 0x3F
    end = at + 5 + more
    if size in (6, 7):
        samples = int.from_bytes(data[end : end + size - 5], "big") + 1
        end += size - 5
    elif size in _SIZES:
        samples = _SIZES[size]
    else:
        raise FlacError("reserved block size")
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:end]) != data[end]:
        raise FlacError("header checksum")
    first = number if data[at + 1] & 1 else number * info.block_min
    return end + 1, samples, channel, _BITS.get(bits, info.bits), first


class _Bits:
    """Reads bits of a stream, most significant first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def unsigned(self, n: int) -> int:
        a, b = self.at >> 3, self.at + n + 7 >> 3
        if b > len(self.data):
            raise FlacError("stream is cut short")
        word = int.from_bytes(self.data[a:b], "big") >> (b << 3) - self.at - n
        self.at += n
        return word & (1 << n) - 1

    def signed(self, n: int) -> int:
        word = self.unsigned(n)
        return word - (1 << n) if n and word >> n - 1 else word

    def unary(self) -> int:
        start = self.at
        while True:
            byte = self.data[self.at >> 3] & 0xFF >> (self.at & 7) if self.at >> 3 < len(self.data) else None
            if byte is None:
                raise FlacError("stream is cut short")
            if byte:
                self.at = (self.at & ~7) + 8 - byte.bit_length()
                self.at += 1
                return self.at - 1 - start
            self.at = (self.at & ~7) + 8


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _residual(bits: _Bits, samples: int, order: int) -> list[int]:
    method = bits.unsigned(2)
    if method > 1:
        raise FlacError("reserved residual coding")
    width = 4 + method
    parts = bits.unsigned(4)
    out: list[int] = []
    for i in range(1 << parts):
        n = (samples >> parts) - (0 if i else order)
        k = bits.unsigned(width)
        if k == (1 << width) - 1:
            raw = bits.unsigned(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            u = bits.unary() << k | bits.unsigned(k)
            out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: _Bits, samples: int, width: int) -> list[int]:
    head = bits.unsigned(8)
    wasted = bits.unary() + 1 if head & 1 else 0
    kind, width = head >> 1 & 0x3F, width - wasted
    if kind == 0:
        out = [bits.signed(width)] * samples
    elif kind == 1:
        out = [bits.signed(width) for _ in range(samples)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        if kind >= 32:
            precision, shift = bits.unsigned(4) + 1, bits.signed(5)
            factors = [bits.signed(precision) for _ in range(order)]
        else:
            factors, shift = list(_FIXED[order]), 0
        for e in _residual(bits, samples, order):
            out.append(e + (sum(c * x for c, x in zip(factors, reversed(out), strict=False)) >> shift))
    else:
        raise FlacError("reserved subframe")
    return [x << wasted for x in out] if wasted else out


def read_frame(data: bytes, at: int, info: Info) -> tuple[int, int, list[list[int]]]:
    """(end, first sample, channels) of the frame at ``at``; both checksums are verified."""
    end, samples, channel, width, first = read_header(data, at, info)
    bits = _Bits(data, end)
    side = {8: 1, 9: 0, 10: 1}.get(channel)
    out = [_subframe(bits, samples, width + (i == side)) for i in range(2 if side is not None else channel + 1)]
    end = bits.at + 7 >> 3
    if int(crc16([data[at:end]])[0]) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError("frame checksum")
    a, *b = out
    if channel == 8:
        out = [a, [x - y for x, y in zip(a, b[0], strict=True)]]
    elif channel == 9:
        out = [[x + y for x, y in zip(a, b[0], strict=True)], b[0]]
    elif channel == 10:
        mid = [m << 1 | s & 1 for m, s in zip(a, b[0], strict=True)]
        out = [[m + s >> 1 for m, s in zip(mid, b[0], strict=True)], [m - s >> 1 for m, s in zip(mid, b[0], strict=True)]]
    return end + 2, first, out


def blocks(data: bytes, from_sample: int = 0) -> Iterator[tuple[int, list[list[int]]]]:
    """(first sample, channels) of each frame, from the frame that holds ``from_sample`` on."""
    info = read_info(data)
    at = info.first
    for first, offset, _ in info.points:
        if first <= from_sample:
            at = max(at, info.first + offset)
    while at < len(data):
        at, first, channels = read_frame(data, at, info)
        if first + len(channels[0]) > from_sample:
            yield first, channels


def decode(data: bytes) -> list[list[int]]:
    """All samples by channel; the digest over all samples is verified where the stream has one."""
    info, out = read_info(data), None
    for _, channels in blocks(data):
        out = channels if out is None else [x + y for x, y in zip(out, channels, strict=True)]
    out = out or [[] for _ in range(info.channels)]
    if any(info.md5):
        size = (info.bits + 7) // 8
        raw = b"".join(x.to_bytes(size, "little", signed=True) for step in zip(*out, strict=True) for x in step)
        if hashlib.md5(raw).digest() != info.md5:
            raise FlacError("digest of samples")
    return out


def seek(data: bytes, sample: int, count: int) -> list[list[int]]:
    """``count`` samples of each channel from ``sample`` on."""
    out: list[list[int]] | None = None
    for first, channels in blocks(data, sample):
        cut = [c[max(0, sample - first) : sample + count - first] for c in channels]
        out = cut if out is None else [x + y for x, y in zip(out, cut, strict=True)]
        if first + len(channels[0]) >= sample + count:
            break
    return out or []


def _decode_group(frames: list[tuple[bytes, Info, int]]) -> list[np.ndarray | None]:
    """Samples of mono 8-bit frames with one Rice partition and a predictor; None for others."""
    n, order, lead, k, lanes, factors = [], [], [], [], [], {}
    found = crc16([f[:-2] for f, _, _ in frames])
    out: list[np.ndarray | None] = [None] * len(frames)
    for i, (frame, info, number) in enumerate(frames):
        if int(found[i]) != int.from_bytes(frame[-2:], "big"):
            raise FlacError("frame checksum")
        end, samples, channel, width, first = read_header(frame, 0, info)
        head = frame[end]
        kind = head >> 1
        if channel or width != 8 or head & 1 or not (8 <= kind <= 10 or kind >= 32) or first != number:
            continue
        o = kind - 8 if kind < 32 else kind - 31
        bits = _Bits(frame, end + 1 + o)
        if kind >= 32:
            precision, shift = bits.unsigned(4) + 1, bits.signed(5)
            factors[i] = (shift, [bits.signed(precision) for _ in range(o)])
        word = bits.unsigned(10)
        if word >> 4 or (word & 15) == 15:  # another coding, several partitions, or an escape
            continue
        lanes.append(i)
        n.append(samples)
        order.append(o)
        lead.append(bits.at)
        k.append(word & 15)
    if not lanes:
        return out
    rows = np.argsort(-(np.array(n) - np.array(order)), kind="stable")  # longest first: active lanes stay in front
    n, order, lead, k = (np.array(x, np.int64)[rows] for x in (n, order, lead, k))
    lanes = [lanes[i] for i in rows]
    data = b"".join(frames[i][0] for i in lanes) + b"\0\0\0\0"
    base = np.concatenate([[0], np.cumsum([len(frames[i][0]) for i in lanes])])[:-1]
    raw = np.frombuffer(data, np.uint8)
    bit = np.unpackbits(raw)
    one = np.where(bit, np.arange(len(bit), dtype=np.int32), np.int32(len(bit) - 1))
    ahead = np.minimum.accumulate(one[::-1])[::-1]  # the next set bit from each place on
    word = raw[:-2].astype(np.int32) << 16 | raw[1:-1].astype(np.int32) << 8 | raw[2:]
    count = n - order
    steps = int(count[0])
    active = len(count) - np.searchsorted(count[::-1], np.arange(steps), "right")
    stop = np.zeros((steps, len(count)), np.int32)
    place = np.zeros((steps + 1, len(count)), np.int32)
    place[0] = base * 8 + lead
    skip = (k + 1).astype(np.int32)
    for j, m in enumerate(active.tolist()):
        stop[j, :m] = ahead[place[j, :m]]
        np.add(stop[j, :m], skip[:m], out=place[j + 1, :m])
    if (place.max(0) > (base + [len(frames[i][0]) - 2 for i in lanes]) * 8).any():
        raise FlacError("residual beyond its frame")
    q = stop - place[:-1]
    after = stop + 1
    k32 = k.astype(np.int32)
    low = word[np.minimum(after >> 3, len(word) - 1)] >> (24 - (after & 7) - k32) & (1 << k32) - 1
    u = q << k32 | low
    steps_e = u >> 1 ^ -(u & 1)
    e = steps_e.T
    warms = []
    for r, i in enumerate(lanes):
        o = int(order[r])
        at = read_header(frames[i][0], 0, frames[i][1])[0] + 1 if o else 0
        warms.append(np.frombuffer(frames[i][0], np.int8, o, at).astype(np.int32))
    fitted = [r for r, i in enumerate(lanes) if i in factors]
    if fitted:
        for r, own in zip(fitted, _undone(steps_e[:, fitted], [warms[r] for r in fitted], [factors[lanes[r]] for r in fitted]), strict=True):
            out[lanes[r]] = own[: int(n[r])]
    for r, i in enumerate(lanes):
        if i in factors:
            continue
        o, m = int(order[r]), int(n[r])
        own = e[r, : m - o]
        if o:
            own = np.concatenate([warms[r], own])
            if o == 2:
                own[1] -= own[0]
                own[1:] = np.cumsum(own[1:])
            own = np.cumsum(own)
        out[i] = own
    return out


def _undone(e: np.ndarray, warms: list[np.ndarray], factors: list[tuple[int, list[int]]]) -> list[np.ndarray]:
    """Samples of frames with fitted predictors, from residuals by step: all frames go from sample to sample."""
    most = max(len(w) for w in warms)
    factor = np.zeros((most, len(warms)), np.int64)  # of the sample ``most`` back first
    x = np.zeros((most + len(e), len(warms)), np.int64)
    for r, (w, (_, own)) in enumerate(zip(warms, factors, strict=True)):
        factor[most - len(own) :, r] = own[::-1]
        x[most - len(w) : most, r] = w
    shift = np.array([s for s, _ in factors], np.int64)
    if (shift < 0).any():
        raise FlacError("negative shift")
    for t, row in enumerate(e):
        x[most + t] = row + ((factor * x[t : t + most]).sum(0) >> shift)
    return [x[most - len(w) :, r].astype(np.int32) for r, w in enumerate(warms)]


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """By stream, of mono 8-bit ones: (first sample, samples) of each frame.  All checksums are verified."""
    todo: list[tuple[bytes, Info, int]] = []
    owner, slow, infos = [], set(), []
    for i, data in enumerate(streams):
        info = read_info(data)
        infos.append(info)
        starts = [info.first + p[1] for p in info.points]
        told = sum(p[2] for p in info.points) == info.samples
        if info.channels != 1 or info.bits != 8 or not told or starts != sorted(set(starts)):
            slow.add(i)
            continue
        for (first, _, _), a, b in zip(info.points, starts, [*starts[1:], len(data)], strict=True):
            todo.append((data[a:b], info, first))
            owner.append(i)
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    for j in range(0, len(todo), LANES):
        group = todo[j : j + LANES]
        for i, (_, _, first), samples in zip(owner[j:], group, _decode_group(group), strict=False):
            if samples is None:
                slow.add(i)
            else:
                out[i].append((first, samples))
    for i, data in enumerate(streams):
        if i in slow:
            out[i] = [(first, np.array(channels[0], np.int32)) for first, channels in blocks(data)]
        if any(infos[i].md5):
            digest = hashlib.md5()
            for _, samples in out[i]:
                digest.update(samples.astype(np.int8).tobytes())
            if digest.digest() != infos[i].md5:
                raise FlacError("digest of samples")
    return out


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payloads (sample plus 128) of mono 8-bit streams."""
    whole = [b"".join(x.astype(np.int8).tobytes() for _, x in own) for own in decode_blocks(streams)]
    return [payload_from(x) for x in whole]


def payload_of(raw: bytes, pad: int = PAD) -> bytes:
    return raw + bytes(-len(raw) % pad or (0 if raw else pad))


def feature_of(payload: bytes) -> str:
    """Whole-number features of the samples: root mean square, zero crossings, peak, mean step."""
    x = samples_of(payload).astype(np.int64)
    rms = math.isqrt(int((x * x).sum()) // len(x))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    step = int(np.abs(np.diff(x)).sum()) // max(1, len(x) - 1)
    return f"rms={rms};zc={crossings};peak={int(np.abs(x).max())};step={step}"


_MEDIA = pa.schema([("__tm_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__tm_id``, ``n_bytes`` and the FLAC stream of each text's padded bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in tk.chunks(batch.column(1), LANES * BLOCK):
            raw = [chunk.text(i) for i in range(chunk.rows)]
            streams = encode_many([payload_of(x) for x in raw])
            yield batch_of(_MEDIA, batch.column(0).slice(chunk.first, chunk.rows), [len(x) for x in raw], streams)

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return arrow_map(narrow, run, "__tm_id long, n_bytes long, media binary")


_BLOCKS = pa.schema([
    ("stream", pa.int64()), ("id", pa.int64()), ("sample_offset", pa.int64()), ("samples", pa.int64()), ("pcm", pa.binary()),
    ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
])
_BLOCKS_SQL = (
    "stream long, id long, sample_offset long, samples long, pcm binary, n_bytes long, media_bytes long, media_sha256 string"
)


def _pcm(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first sample, samples, interleaved little-endian PCM) of the blocks of any stream."""
    info = read_info(data)
    size = (info.bits + 7) // 8
    for first, channels in blocks(data):
        pcm = b"".join(x.to_bytes(size, "little", signed=True) for step in zip(*channels, strict=True) for x in step)
        yield first, len(channels[0]), pcm


def pcm_blocks(media: DataFrame, id_col: str = "__tm_id", media_col: str = "media", size_col: str | None = None) -> DataFrame:
    """Blocks of PCM with the offsets of their first samples, from any streams.

    ``stream`` numbers the streams of a run; the rows of one follow each other in the order of their offsets.
    Each row also has the stream's size and digest, and ``n_bytes`` from ``size_col``.
    """
    ship_package(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = TaskContext.get().partitionId() << 36
        for batch in batches:
            held = [x.as_py() for x in batch.column(1)]
            at = 0
            while at < len(held):
                to, size = at, 0
                while to < len(held) and (to == at or size + len(held[to] or b"") <= LANES * BLOCK):
                    size += len(held[to] or b"")
                    to += 1
                infos = {i: read_info(held[i]) for i in range(at, to) if held[i]}
                fast = [i for i, info in infos.items() if info.channels == 1 and info.bits == 8]
                found = dict(zip(fast, decode_blocks([held[i] for i in fast]), strict=True))
                for i in infos:
                    if i in found:
                        own = [(first, len(x), x.astype(np.int8).tobytes()) for first, x in found[i]]
                    else:
                        own = list(_pcm(held[i]))
                    stream += 1
                    n, same = len(own), [c[i : i + 1].to_pylist() * len(own) for c in (batch.column(k) for k in (0, 2, 3, 4))]
                    yield batch_of(_BLOCKS, [stream] * n, same[0], *(list(x) for x in zip(*own, strict=True)), *same[1:])
                at = to

    size = F.col(size_col).cast("long") if size_col else F.lit(None).cast("long")
    narrow = media.select(
        F.col(id_col).cast("long"), F.col(media_col), size, F.length(media_col).cast("long"), F.sha2(F.col(media_col), 256)
    )
    return map_batches(narrow, run, _BLOCKS_SQL)


_REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
_REPORT_SQL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def media_report(media: DataFrame) -> DataFrame:
    """What streams of ``text_media`` hold: their blocks of PCM put together by their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, at, parts, about = None, 0, [], ()

        def whole() -> tuple:
            payload = payload_from(b"".join(parts))
            doc, n_bytes, size, digest = about
            return (
                doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), size, digest,
                feature_of(payload),
            )

        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in range(len(_BLOCKS))]
            for s, doc, offset, samples, pcm, n_bytes, size, digest in zip(*columns, strict=True):
                if s != stream:
                    if parts:
                        rows.append(whole())
                    stream, at, parts, about = s, 0, [], (doc, n_bytes, size, digest)
                if offset != at:
                    raise FlacError("blocks are not in order")
                parts.append(pcm)
                at += samples
            if rows:
                yield batch_of(_REPORT, *(list(x) for x in zip(*rows, strict=True)))
        if parts:
            yield batch_of(_REPORT, *([x] for x in whole()))

    return map_batches(pcm_blocks(media, size_col="n_bytes"), run, _REPORT_SQL)


def stored_report(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report of streams that are stored as a table and read back.

    Streams of texts are about as long as the texts.  So that not all of them are on disk at once, documents
    go through in ``batches`` by a hash of their ids; the streams of one are deleted when its rows are written.
    """
    space = Workspace(docs.sparkSession, "flac")
    out = None
    for batch in range(batches):
        own = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)) == batch)
        media = space.save(text_media(own, id_col, text_col), f"media-{batch}")
        rows = space.save(media_report(media), f"report-{batch}")
        space.drop(f"media-{batch}")
        out = rows if out is None else out.unionByName(rows)
    return out


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_report(table(spark, sf_dir, "documents"))
