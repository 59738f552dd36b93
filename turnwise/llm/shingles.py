"""Word shingles as 64-bit hashes, computed over whole Arrow batches.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; multi-byte characters
consist of other bytes, so UTF-8 needs no decoding. A shingle is `width` words; a text with
fewer words is one shingle, its whole sequence; a text without words has none. Two different
shingles get one hash with probability 2^-64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = _constants(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    part = _BYTE[data[starts[0] :]] * _powers(int(lengths.max()))[at]
    part[~inside[starts[0] :]] = 0
    hashes = np.add.reduceat(part, starts - starts[0])
    return _mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(text: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, unsigned."""
    words, owner = word_hashes(text)
    counts = np.bincount(owner, minlength=len(text))
    factors = _constants(width, 2)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        rolled += words[i : i + len(rolled)] * factors[i]
    rolled = _mix(rolled + np.uint64(width))
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(_mix((words[at : at + n] * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def set_print(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set; equal sets have equal prints."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
