"""Words of whole texts as 64-bit hashes, a buffer at a time.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z: digits, letters and every character
beyond ASCII. In UTF-8 all bytes of such characters are 0x80 and more, so the bytes can be classed one by one. Two words
are taken as equal if their hashes are; the hash is a polynomial over a random byte table, mixed at the end.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _lowered() -> np.ndarray:
    """For each byte what a word holds of it; 0 where it ends a word."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    return np.where(((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128), low, 0).astype(np.uint8)


LOWERED = _lowered()
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse for i up to n, kept for the next call."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 2 * _CHUNK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, of all words in turn; one more axis first where leading parts are asked for
    bounds: np.ndarray  # int64, rows + 1: the words of row i are hashes[bounds[i]:bounds[i + 1]]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's bounds in them; a null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunk(low: np.ndarray, starts_text: np.ndarray, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one chunk; the hash of a part as long as its word is the word's."""
    on = low != 0
    before = np.empty_like(on)
    before[0] = False
    before[1:] = on[:-1]
    before[starts_text] = False
    after = np.empty_like(on)
    after[-1] = False
    after[:-1] = on[1:]
    after[starts_text[starts_text > 0] - 1] = False
    starts = np.flatnonzero(on & ~before)
    ends = np.flatnonzero(on & ~after) + 1
    up, down = powers(len(low) + 1)
    sums = np.empty(len(low) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[low] * up[: len(low)], out=sums[1:])

    def of(to: np.ndarray) -> np.ndarray:
        return mix((sums[to] - sums[starts]) * down[starts] + (to - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    if not parts:
        return of(ends), starts
    # A part is marked as one, so that it never equals a word spelled so.
    return np.stack([of(ends), *(np.where(ends - starts > n, of(np.minimum(starts + n, ends)) ^ U(0x5851F42D4C957F2D), U(0)) for n in parts)]), starts


def words(texts: pa.Array, parts: tuple[int, ...] = ()) -> Words:
    """The words of each text. Bytes are taken about a megabyte at a time, cut where no word is cut.

    parts: also the hashes of each word's first so many bytes, 0 where the word has no more than those.
    """
    data, bounds = buffers(texts)
    hashes, begins, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + _CHUNK)
        low = LOWERED[data[at:to]]
        if to < len(data):
            gaps = np.flatnonzero(low[-4096:] == 0)
            while not len(gaps) and to < len(data):  # a word of thousands of bytes: go on to its end
                to = min(len(data), to + _CHUNK)
                low = LOWERED[data[at:to]]
                gaps = np.flatnonzero(low[-_CHUNK:] == 0)
                if len(gaps):
                    gaps = gaps + max(0, len(low) - _CHUNK) - max(0, len(low) - 4096)
            if to < len(data) and len(gaps):
                keep = max(0, len(low) - 4096) + int(gaps[-1]) + 1
                low, to = low[:keep], at + keep
        inside = bounds[(bounds >= at) & (bounds < to)] - at
        h, s = _chunk(low, inside, parts)
        hashes.append(h)
        begins.append(s + at)
        at = to
    h = np.concatenate(hashes, axis=-1) if hashes else np.zeros((1 + len(parts), 0) if parts else 0, np.uint64)
    s = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return Words(h, np.searchsorted(s, bounds, side="left").astype(np.int64))


_odd = mix(np.arange(1, 65, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on; positions whose run leaves its text must be dropped by the caller."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _odd[0]
    for j in range(1, k):
        out += h[j : j + n] * _odd[j]
    return mix(out)


def grams_at(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """grams(h, k) of these positions only."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out += h[starts + j] * _odd[j]
    return mix(out)


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n first positions have k words before their text ends."""
    ok = np.ones(n, bool)
    for j in range(1, k):
        cut_at = bounds[1:] - j
        cut_at = cut_at[(cut_at >= 0) & (cut_at < n)]
        ok[cut_at] = False
    return ok
