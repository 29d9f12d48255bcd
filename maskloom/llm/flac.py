"""FLAC streams of 8-bit mono samples: a writer, and a reader of Rice residuals and linear predictors.

Both work on all frames of a batch in step: step i of the reader takes the i-th residual of every frame, so the cost is a
few array operations a sample. The reader takes what a mono stream of up to 16 bits can hold: constant, verbatim, fixed and
LPC subframes, wasted bits, Rice codes of 4 and 5 bits with escapes, every block size code, and checks CRC-8 of headers,
CRC-16 of frames and MD5 of the samples. Frames are found by the stream's seek table, which the writer gives a point for
every frame, so any sample offset can be read alone. Frames with escapes go through a plain reader, one by one.

The writer makes frames of ``BLOCK`` samples, each with the cheaper of verbatim samples, a fixed predictor of order 0 or 1
and a quantised LPC of order 2 and 4 from its autocorrelation, in integer arithmetic, so equal samples give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

import numpy as np

BLOCK = 1024
_PRECISION = 12


class CorruptFrame(ValueError):
    """A checksum or a sync code doesn't hold."""


def _crc8_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        t = np.where(t & 0x80, (t << 1) ^ 0x07, t << 1) & 0xFF
    return t.astype(np.uint8)


def _crc16_pairs() -> np.ndarray:
    """The CRC-16 after two bytes, by the state xor those bytes."""
    t = np.arange(65536, dtype=np.uint32)
    for _ in range(16):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


CRC8, CRC16 = _crc8_table(), _crc16_pairs()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of the first so many bytes of each row. rows: uint8, one row a frame, sorted by falling length."""
    state = np.zeros(len(rows), np.uint16)
    pairs = (rows[:, 0 : rows.shape[1] // 2 * 2 : 2].astype(np.uint16) << 8) | rows[:, 1 : rows.shape[1] // 2 * 2 : 2]
    pairs = np.ascontiguousarray(pairs.T)
    active = np.searchsorted(-(lengths // 2), -np.arange(pairs.shape[0]) - 1, side="right")
    for i in range(pairs.shape[0]):
        n = int(active[i])
        if not n:
            break
        state[:n] = CRC16[state[:n] ^ pairs[i, :n]]
    odd = np.flatnonzero(lengths % 2)
    if len(odd):
        last = rows[odd, lengths[odd] - 1].astype(np.uint16)
        s = state[odd]
        state[odd] = (s << 8) ^ _one(((s >> 8) ^ last).astype(np.uint16))
    return state


def _one(x: np.ndarray) -> np.ndarray:
    """CRC-16 of the single byte x."""
    t = x.astype(np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


# --- writer -----------------------------------------------------------------------------------------------------------


def _levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients of all rows from autocorrelations of lags 0 to order, as floats of plain operations."""
    n = len(r)
    a = np.zeros((order, n))
    error = r[:, 0] + 1e-9
    for i in range(order):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[j] * r[:, i - j]
        k /= error
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a = new
        error = np.maximum(error * (1 - k * k), 1e-9)
    return a


def _best_k(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the Rice parameter near the logarithm of the mean that takes the fewest bits, and those bits."""
    n = z.shape[1]
    about = np.searchsorted(2 ** np.arange(1, 15), z.sum(axis=1, dtype=np.int64) // n, side="right")
    tried = np.clip(np.stack([about - 1, about, about + 1], axis=1), 0, 14)
    bits = np.stack([(z >> tried[:, j : j + 1].astype(np.int32)).sum(axis=1, dtype=np.int64) + n * (tried[:, j] + 1) for j in range(3)], axis=1)
    i = bits.argmin(axis=1)
    rows = np.arange(len(z))
    return tried[rows, i], bits[rows, i]


class _Choice(NamedTuple):
    size: np.ndarray  # bits of the subframe with its header
    order: int
    coefficients: np.ndarray | None  # rows x order
    shift: np.ndarray | None
    k: np.ndarray
    z: np.ndarray


def _coded(residual: np.ndarray, order: int, head: int, coefficients=None, shift=None) -> _Choice:
    z = ((residual << 1) ^ (residual >> 31)).astype(np.int32)
    k, bits = _best_k(z)
    return _Choice(bits + 8 + head + 8 * order + 10, order, coefficients, shift, k, z)


def _choices(x: np.ndarray) -> list[_Choice]:
    """What predictors make of frames of equal length."""
    out = [_coded(x, 0, 0)]
    if x.shape[1] > 1:
        out.append(_coded(x[:, 1:] - x[:, :-1], 1, 0))
    wide = x.astype(np.int64)
    for order in (2, 4):
        if x.shape[1] <= 2 * order:
            continue
        r = np.stack([(wide[:, lag:] * wide[:, : x.shape[1] - lag]).sum(axis=1) for lag in range(order + 1)], axis=1).astype(float)
        a = _levinson(r, order)
        top = np.maximum(np.abs(a).max(axis=0), 1e-9)
        shift = np.full(len(x), 10, np.int64)
        for _ in range(11):  # the largest shift with which all coefficients fit
            shift = np.where((np.rint(top * 2.0**shift) > 2 ** (_PRECISION - 1) - 1) & (shift > 0), shift - 1, shift)
        q = np.clip(np.rint(a * 2.0**shift), -(2 ** (_PRECISION - 1)), 2 ** (_PRECISION - 1) - 1).astype(np.int32).T
        guess = np.zeros((len(x), x.shape[1] - order), np.int32)
        for j in range(order):
            guess += q[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
        out.append(_coded(x[:, order:] - (guess >> shift[:, None].astype(np.int32)), order, 9 + order * _PRECISION, q, shift))
    return out


def _utf8(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> 6 * (size - 1), *tail])


def _header(number: int, size: int) -> bytes:
    code = 0b0110 if size <= 256 else 0b0111
    head = bytes([0xFF, 0xF8, code << 4, 0b0000_001_0]) + _utf8(number) + ((size - 1).to_bytes(1 if size <= 256 else 2, "big"))
    return head + bytes([crc8(head)])


def _pack(fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """Bytes of a bit string; fields: arrays of position, width up to 32 and value."""
    at, width, value = (np.concatenate(x) for x in zip(*fields, strict=True))
    v = value.astype(np.uint64) << np.minimum(64 - width - (at & 31), 63).astype(np.uint64)  # a field of no width is 0
    size, i = bits // 32 + 2, at >> 5
    # No two fields overlap, so sums of floats are exact.
    words = np.bincount(i, weights=(v >> np.uint64(32)).astype(float), minlength=size)
    words += np.bincount(i + 1, weights=(v & np.uint64(0xFFFFFFFF)).astype(float), minlength=size)
    return words.astype(np.uint64).astype(">u4").view(np.uint8)


class Frames(NamedTuple):
    data: np.ndarray  # uint8, all frames in turn
    bounds: np.ndarray
    sizes: np.ndarray  # samples
    stream: np.ndarray


def frames_of(samples: np.ndarray, bounds: np.ndarray) -> Frames:
    """Frames of all streams: samples[bounds[i]:bounds[i + 1]] (int8) is stream i, which has some."""
    lengths = np.diff(bounds)
    per = -(-lengths // BLOCK)
    stream = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(per) - per, per)
    start = bounds[stream] + number * BLOCK
    sizes = np.minimum(BLOCK, bounds[stream + 1] - start)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        for lo in range(0, len(which), max(1, (1 << 20) // int(size))):
            out.append(_equal_frames(samples, start, number, which[lo : lo + max(1, (1 << 20) // int(size))], int(size)))
    byte_len = np.zeros(len(stream), np.int64)
    for which, n in ((w, n) for w, n, _ in out):
        byte_len[which] = n
    at = np.concatenate(([0], np.cumsum(byte_len)))
    data = np.zeros(int(at[-1]), np.uint8)
    for which, n, packed in out:
        own = np.concatenate(([0], np.cumsum(n)))
        data[np.repeat(at[which] - own[:-1], n) + np.arange(int(own[-1]))] = packed
    return Frames(data, at, sizes, stream)


def _equal_frames(samples, start, number, which, size):
    """Bytes of the frames named, which have equal numbers of samples: (which, bytes of each, all bytes)."""
    x = samples[start[which][:, None] + np.arange(size)].astype(np.int32)
    n = len(x)
    choices = _choices(x)
    cost = np.stack([np.full(n, 8 + 8 * size), *(c.size for c in choices)], axis=1)
    best = cost.argmin(axis=1)
    heads = [_header(int(i), size) for i in number[which]]
    head_len = np.array([len(h) for h in heads])
    total = head_len * 8 + cost[np.arange(n), best]
    byte_len = (total + 7) // 8 + 2
    base = (np.concatenate(([0], np.cumsum(byte_len)))[:-1]) * 8
    body = base + head_len * 8
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(at, width, value):
        at, width, value = np.broadcast_arrays(at, width, value)
        fields.append((at.ravel(), width.ravel(), value.ravel()))

    rows = np.flatnonzero(best == 0)
    if len(rows):
        put(body[rows], 8, 0b0_000001_0)
        put(body[rows][:, None] + 8 + 8 * np.arange(size), 8, x[rows] & 0xFF)
    for c, made in enumerate(choices, 1):
        rows = np.flatnonzero(best == c)
        if not len(rows):
            continue
        at = body[rows]
        put(at, 8, (0b0_001000_0 | made.order << 1) if made.coefficients is None else 0b0_100000_0 | (made.order - 1) << 1)
        at = at + 8
        if made.order:
            put(at[:, None] + 8 * np.arange(made.order), 8, x[rows][:, : made.order] & 0xFF)
            at = at + 8 * made.order
        if made.coefficients is not None:
            put(at, 4, _PRECISION - 1)
            put(at + 4, 5, made.shift[rows])
            put(at[:, None] + 9 + _PRECISION * np.arange(made.order), _PRECISION, made.coefficients[rows] & ((1 << _PRECISION) - 1))
            at = at + 9 + _PRECISION * made.order
        put(at, 6, 0)  # 4-bit parameters, one partition
        k = made.k[rows]
        put(at + 6, 4, k)
        at = at + 10
        z = made.z[rows]
        q = z >> k[:, None]
        length = q + 1 + k[:, None]
        ends = np.cumsum(length, axis=1)
        put(at[:, None] + ends - 1 - k[:, None], k[:, None] + 1, (1 << k[:, None]) | (z & ((1 << k[:, None]) - 1)))
    packed = _pack(fields, int(byte_len.sum()) * 8)[: int(byte_len.sum())].copy()
    first = base // 8
    for i, h in enumerate(heads):
        packed[first[i] : first[i] + len(h)] = np.frombuffer(h, np.uint8)
    order = np.argsort(-byte_len, kind="stable")
    square = np.zeros((n, int(byte_len.max())), np.uint8)
    inside = np.arange(square.shape[1]) < byte_len[:, None]
    square[inside] = packed
    crc = np.zeros(n, np.uint16)
    crc[order] = crc16(square[order], byte_len[order] - 2)
    packed[first + byte_len - 2], packed[first + byte_len - 1] = crc >> 8, crc & 0xFF
    return which, byte_len, packed


def streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes are the samples; a payload has at least 16 bytes."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    f = frames_of(np.frombuffer(b"".join(payloads), np.int8), bounds)
    out = []
    cuts = np.searchsorted(f.stream, np.arange(len(payloads) + 1))
    n_bytes = np.diff(f.bounds)
    for i, p in enumerate(payloads):
        a, b = int(cuts[i]), int(cuts[i + 1])
        points = np.zeros(b - a, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"] = np.arange(b - a) * BLOCK
        points["offset"] = f.bounds[a:b] - f.bounds[a]
        points["size"] = f.sizes[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(n_bytes[a:b].min()).to_bytes(3, "big") + int(n_bytes[a:b].max()).to_bytes(3, "big")
        info += ((8000 << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(p).digest()
        table = points.tobytes()
        fits = len(table) < 1 << 24  # of a payload of more than 954 MB frames are found by their headers
        tail = b"\x83" + len(table).to_bytes(3, "big") + table if fits else b""
        out.append(b"fLaC" + (b"\x00" if fits else b"\x80") + len(info).to_bytes(3, "big") + info + tail + f.data[f.bounds[a] : f.bounds[b]].tobytes())
    return out


# --- reader -----------------------------------------------------------------------------------------------------------


class Info(NamedTuple):
    samples: int
    bits: int
    md5: bytes
    points: np.ndarray  # sample, offset, size; offsets from the first frame
    first: int  # where the first frame begins


def opened(stream: bytes) -> Info:
    """The metadata of a mono stream, and a point for each frame: those of its seek table, if it has one of all frames."""
    if stream[:4] != b"fLaC":
        raise CorruptFrame("no FLAC stream")
    if len(stream) < 8:
        raise CorruptFrame("a stream cut short")
    at, info, points = 4, None, None
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            v = int.from_bytes(body[10:18], "big")
            if v >> 41 & 7:
                raise ValueError("only mono streams are read")
            info = (v & (1 << 36) - 1, (v >> 36 & 31) + 1, body[18:34])
        elif kind & 0x7F == 3:
            points = np.frombuffer(body, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
            points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
        if kind & 0x80:
            break
        if at + 4 > len(stream):
            raise CorruptFrame("a stream cut short")
    if info is None:
        raise CorruptFrame("a stream without its info")
    if points is None or int(points["size"].sum()) != info[0]:
        points = _by_headers(stream, at)
    return Info(*info, points, at)


def _by_headers(stream: bytes, first: int) -> np.ndarray:
    """A point for each frame, found by sync codes whose headers' CRC-8 is right."""
    view, at, sample, rows = memoryview(stream), first, 0, []
    while at < len(stream):
        size, head = _frame_header(view[at:])
        rows.append((sample, at - first, size))
        sample, at = sample + size, at + head
        while at < len(stream):
            found = min((x for x in (stream.find(b"\xff\xf8", at), stream.find(b"\xff\xf9", at)) if x >= 0), default=len(stream))
            at = found
            try:
                if at < len(stream):
                    _frame_header(view[at:])
                break
            except (ValueError, IndexError, KeyError):
                at += 1
    return np.array(rows, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])


_SIZES = {1: 192, **{i: 576 << i - 2 for i in range(2, 6)}, **{i: 256 << i - 8 for i in range(8, 16)}}


def _frame_header(data: memoryview) -> tuple[int, int]:
    """(samples, bytes of the header); its CRC-8 is checked."""
    if data[0] != 0xFF or data[1] & 0xFE != 0xF8:
        raise CorruptFrame("no sync code")
    code, rate = data[2] >> 4, data[2] & 15
    if data[3] >> 4:
        raise ValueError("only mono frames are read")
    lead = data[4]
    at = 5 + (0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1)
    if code == 6:
        size, at = data[at] + 1, at + 1
    elif code == 7:
        size, at = int.from_bytes(data[at : at + 2], "big") + 1, at + 2
    else:
        size = _SIZES[code]
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(bytes(data[:at])) != data[at]:
        raise CorruptFrame("CRC-8 of a frame header")
    return size, at + 1


#: Coefficients of the fixed predictors of order 0 to 4.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def decoded(frames: list[bytes | memoryview], bits: int = 8) -> list[np.ndarray]:
    """The samples of each frame, checksums verified; int32."""
    n = len(frames)
    if not n:
        return []
    lengths = np.array([len(f) for f in frames], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(frames) + b"\0" * 16, np.uint8)
    square = np.zeros((n, int(lengths.max())), np.uint8)
    square[np.arange(square.shape[1]) < lengths[:, None]] = data[: starts[-1]]
    if crc16(square[order], lengths[order]).any():  # over a frame with its own CRC it is 0
        raise CorruptFrame("CRC-16 of a frame")
    del square
    out: list[np.ndarray | None] = [None] * n
    lanes: list[tuple] = []
    for i, frame in enumerate(frames):
        view = memoryview(frame)
        size, head = _frame_header(view)
        kind = view[head]
        at = int(starts[i]) * 8 + head * 8 + 8
        if kind & 0x80:
            raise CorruptFrame("padding of a subframe")
        kind = kind >> 1 & 63
        if view[head] & 1 or kind in (0, 1) and bits != 8:
            out[i] = _plain(frame, bits)
        elif kind == 0:
            out[i] = np.full(size, _signed(data, at, bits), np.int32)
        elif kind == 1:
            a = at >> 3
            out[i] = data[a : a + size].view(np.int8).astype(np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            p = kind - 8 if kind < 32 else kind - 31
            warm = [_signed(data, at + bits * j, bits) for j in range(p)]
            at += bits * p
            shift, coefficients = 0, list(_FIXED[p]) if kind < 32 else []
            if kind >= 32:
                precision = _unsigned(data, at, 4) + 1
                shift = _signed(data, at + 4, 5)
                coefficients = [_signed(data, at + 9 + precision * j, precision) for j in range(p)]
                at += 9 + precision * p
            method, parts = _unsigned(data, at, 2), _unsigned(data, at + 2, 4)
            lanes.append((i, size, p, warm, coefficients, shift, at + 6, 4 + method, parts))
        else:
            raise CorruptFrame("reserved subframe")
    if lanes:
        _in_step(data, lanes, out, frames, bits)
    return out


def _unsigned(data: np.ndarray, at: int, width: int) -> int:
    a = at >> 3
    return int.from_bytes(data[a : a + 8].tobytes(), "big") >> (64 - width - (at & 7)) & ((1 << width) - 1)


def _signed(data: np.ndarray, at: int, width: int) -> int:
    v = _unsigned(data, at, width)
    return v - (1 << width) if v >> width - 1 else v


def _in_step(data, lanes, out, frames, bits):
    """Residuals and predictors of all lanes, longest first, a sample of each a step."""
    lanes.sort(key=lambda x: -(x[1] - x[2]))
    count = np.array([x[1] - x[2] for x in lanes])
    n, steps = len(lanes), int(count[0])
    one = np.flatnonzero(np.unpackbits(data))
    nearest = np.empty(len(data) * 8 + 1, np.int32 if len(data) * 8 < 1 << 31 else np.int64)
    edges = np.concatenate(([-1], one))
    nearest[: int(edges[-1]) + 1] = np.repeat(one, np.diff(edges))
    nearest[int(edges[-1]) + 1 :] = len(data) * 8
    window = np.zeros(len(data), np.uint64)
    for j in range(5):
        window[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(32 - 8 * j)

    def read(at, width):  # up to 32 bits
        return (window[at >> 3] >> (40 - width - (at & 7)).astype(np.uint64)).astype(np.int64) & ((1 << width) - 1)

    at = np.array([x[6] for x in lanes], np.int64)
    width = np.array([x[7] for x in lanes], np.int64)
    k = np.zeros(n, np.int64)
    bad = np.zeros(n, bool)
    when: dict[int, list[int]] = {}
    for lane, x in enumerate(lanes):
        part = x[1] >> x[8]
        for j in range(1 << x[8]):
            step = max(0, part * j - x[2])
            if j == 0 or step < count[lane]:
                when.setdefault(step, []).append(lane)
    begin, stop, ks = (np.zeros((steps, n), np.int64) for _ in range(3))
    active = np.searchsorted(-count, -np.arange(steps) - 1, side="right")
    last = len(data) * 8 - 64
    for i in range(steps):
        m = int(active[i])
        if i in when:
            w = np.array([x for x in when[i] if x < m], np.int64)
            got = read(at[w], width[w])
            bad[w] |= got == (1 << width[w]) - 1
            k[w] = np.where(bad[w], 0, got)
            at[w] += width[w]
        now = at[:m]
        begin[i, :m] = now
        found = nearest[now]
        stop[i, :m] = found
        ks[i, :m] = k[:m]
        at[:m] = np.minimum(found + (k[:m] + 1), last)
    z = ((stop - begin) << ks) | (window[np.minimum((stop + 1) >> 3, len(data) - 1)] >> (40 - ks - ((stop + 1) & 7)).astype(np.uint64)).astype(np.int64) & ((1 << ks) - 1)
    residual = (z >> 1) ^ -(z & 1)
    orders = np.array([x[2] for x in lanes])
    for p in np.unique(orders):
        own = np.flatnonzero((orders == p) & ~bad)
        if not len(own):
            continue
        p = int(p)
        x = np.zeros((p + int(count[own[0]]), len(own)), np.int64)
        for j in range(p):
            x[j] = [lanes[i][3][j] for i in own]
        x[p:] = residual[: len(x) - p, own]
        if p:
            c = np.array([lanes[i][4][::-1] for i in own], np.int64).T
            shift = np.array([lanes[i][5] for i in own], np.int64)
            live = np.searchsorted(-count[own], -np.arange(len(x) - p) - 1, side="right")
            if p == 1 and (c == 1).all() and not shift.any():
                np.cumsum(x, axis=0, out=x)
            else:
                for i in range(len(x) - p):
                    m = int(live[i])
                    x[p + i, :m] += (c[:, :m] * x[i : i + p, :m]).sum(axis=0) >> shift[:m]
        x = np.ascontiguousarray(x.T.astype(np.int32))
        for row, lane in enumerate(own.tolist()):
            out[lanes[lane][0]] = x[row, : lanes[lane][1]]
    for lane in np.flatnonzero(bad).tolist():
        out[lanes[lane][0]] = _plain(frames[lanes[lane][0]], bits)


def _plain(frame: bytes | memoryview, bits: int) -> np.ndarray:
    """The samples of one frame, value by value: for wasted bits and escaped partitions."""
    size, head = _frame_header(memoryview(frame))
    text = "".join(f"{b:08b}" for b in bytes(frame[head:]))
    at = 0

    def take(width: int) -> int:
        nonlocal at
        at += width
        return int(text[at - width : at], 2) if width else 0

    def signed(width: int) -> int:
        v = take(width)
        return v - (1 << width) if width and v >> width - 1 else v

    def unary() -> int:
        nonlocal at
        to = text.index("1", at)
        n, at = to - at, to + 1
        return n

    take(1)
    kind, wasted = take(6), 0
    if take(1):
        wasted = unary() + 1
        bits -= wasted
    if kind == 0:
        x = [signed(bits)] * size
    elif kind == 1:
        x = [signed(bits) for _ in range(size)]
    else:
        p = kind - 8 if kind < 32 else kind - 31
        x = [signed(bits) for _ in range(p)]
        shift, c = 0, list(_FIXED[p]) if kind < 32 else []
        if kind >= 32:
            precision = take(4) + 1
            shift = signed(5)
            c = [signed(precision) for _ in range(p)]
        width = 4 + take(2)
        parts = take(4)
        for j in range(1 << parts):
            n = (size >> parts) - (p if j == 0 else 0)
            k = take(width)
            raw = take(5) if k == (1 << width) - 1 else None
            for _ in range(n):
                if raw is None:
                    z = unary() << k | take(k)
                    r = z >> 1 ^ -(z & 1)
                else:
                    r = signed(raw)
                x.append(r + (sum(a * x[-1 - i] for i, a in enumerate(c)) >> shift))
    return np.array([v << wasted for v in x], np.int32)


#: Frames that are decoded in step: a few dozen bytes of working memory for each of their samples.
_RUN = 512


def samples(all_streams: list[bytes]) -> list[np.ndarray]:
    """All samples of each stream, its frames found by the seek table, checksums and MD5 verified; int8 for 8 bits."""
    infos = [opened(s) for s in all_streams]
    frames: list[memoryview] = []
    for s, info in zip(all_streams, infos, strict=True):
        ends = np.append(info.points["offset"][1:].astype(np.int64), len(s) - info.first) + info.first
        frames += [memoryview(s)[info.first + int(a) : int(b)] for a, b in zip(info.points["offset"], ends, strict=True)]
    if len({i.bits for i in infos}) > 1:
        raise ValueError("streams of one sample size are read together")
    bits = infos[0].bits if infos else 8
    if bits not in (8, 16):
        raise ValueError("samples of 8 or 16 bits are read")
    kind = np.dtype(np.int8 if bits == 8 else "<i2")
    got = [x.astype(kind) for a in range(0, len(frames), _RUN) for x in decoded(frames[a : a + _RUN], bits)]
    out, at = [], 0
    for info in infos:
        kept = np.concatenate(got[at : at + len(info.points)]) if len(info.points) else np.zeros(0, kind)
        got[at : at + len(info.points)] = [None] * len(info.points)
        at += len(info.points)
        if len(kept) != info.samples or any(info.md5) and hashlib.md5(kept.tobytes()).digest() != info.md5:
            raise CorruptFrame("MD5 or number of the samples")
        out.append(kept)
    return out


def seek(stream: bytes, first: int, n: int) -> np.ndarray:
    """n samples from an offset on; only the frames that hold them are read."""
    info = opened(stream)
    starts = info.points["sample"].astype(np.int64)
    a = max(0, int(np.searchsorted(starts, first, side="right")) - 1)
    b = max(a + 1, int(np.searchsorted(starts, first + n, side="left")))
    ends = np.append(info.points["offset"].astype(np.int64), len(stream) - info.first)
    frames = [memoryview(stream)[info.first + int(ends[i]) : info.first + int(ends[i + 1])] for i in range(a, min(b, len(starts)))]
    x = np.concatenate(decoded(frames, info.bits))
    return x[first - int(starts[a]) : first - int(starts[a]) + n]
