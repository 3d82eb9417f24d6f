"""Words of texts as numbers, in numpy, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
#: Bytes that belong to no word: all of ASCII but digits and small letters.
_SEPARATOR = np.array([b < 0x80 and not (chr(b).isdigit() or "a" <= chr(b) <= "z") for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from its bytes by eights."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(_U))
    at = np.arange(len(starts))
    k = 0
    while len(at):
        part = eights[starts[at] + k]
        short = np.flatnonzero(left[at] - k < 8)
        part[short] &= (_U(1) << (_U(8) * (left[at[short]] - k).astype(_U))) - _U(1)
        out[at] = mix(out[at] * _U(0x9E3779B97F4A7C15) + part)
        k += 8
        at = at[left[at] > k]
    return out


def word_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each lower-case text the sorted distinct hashes of its words: runs of a-z, 0-9 and anything beyond ASCII; null counts as empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1)
        # a separator after each text, so that no word runs into the next one
        buf = np.insert(raw[offs[row] : offs[end]], offs[row + 1 : end + 1] - offs[row], 32)
        edges = offs[row + 1 : end + 1] - offs[row] + np.arange(1, end - row + 1)
        inside = np.concatenate(([False], ~_SEPARATOR[buf]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        hashes = _hashes(buf, starts, ends)
        first = 0
        for last in np.searchsorted(starts, edges).tolist():
            own = np.sort(hashes[first:last])
            yield own[np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))]
            first = last
        row = end


def set_number(s: np.ndarray) -> int:
    """One signed 64-bit number for equal sets."""
    return int(mix(np.array([mix(s ^ _U(0x6A09E667F3BCC909)).sum(dtype=_U) + _U(len(s))]))[0].astype(np.int64))
