"""Vectorised hashes over UTF-8 bytes, used inside tasks.

Words and shingles are compared by 64-bit hashes; sets by a pair of them.
Texts are hashed in chunks of a few MB, so memory does not follow the length
of a document.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once.  A longer text is cut at white space, which never changes a word.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_WORD_FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9E3779B185EBCA87], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER, _POWER_INVERSE = _powers(_BASE, 2 * CHUNK), _powers(_BASE_INVERSE, 2 * CHUNK)


def running(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over bytes, and the powers that undo the start of a slice."""
    n = len(codes)
    power, inverse = (_POWER, _POWER_INVERSE) if n < len(_POWER) else (_powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[codes] * power[:n], out=sums[1:])
    return sums, inverse


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, inverse = running(codes)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


#: White space of the word rule: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _pieces(data: bytes) -> list[bytes]:
    """A long text cut at white space near every CHUNK bytes."""
    out, at = [], 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(c, at, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word longer than a chunk
            rest = [p for p in (data.find(c, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
            cut = min(rest, default=len(data))
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def _hashes_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return slice_hashes(codes, starts, ends), starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, in order; A-Z count as a-z."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            hashes, starts = _hashes_of(b" ".join(group))
            begin = np.cumsum([0] + [len(t) + 1 for t in group])
            out.extend(np.split(hashes, np.searchsorted(starts, begin[1:-1])))
            group.clear()
            size = 0

    for text in texts:
        text = text.lower()
        if size + len(text) > CHUNK:
            flush()
        if len(text) > CHUNK:
            out.append(np.concatenate([_hashes_of(p)[0] for p in _pieces(text)]))
        else:
            group.append(text)
            size += len(text) + 1
    flush()
    return out


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of fewer words, the one of them all."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _WORD_FACTORS[i % 5]
        total = mix(total)
    return np.unique(total + np.uint64(width))
