"""Vectorised words, prefix hashes and shingles over whole Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble uint64 values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_KEPT_POWERS = 1 << 19
_powers_by_base: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base`` modulo 2 ** 64; a table of fixed size serves all but the longest texts."""
    if base not in _powers_by_base or n > _KEPT_POWERS:
        out = np.full(max(n, _KEPT_POWERS), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > _KEPT_POWERS:
            return out
        _powers_by_base[base] = out
    return _powers_by_base[base][:n]


class Words:
    """The words of a text column: maximal runs outside space and tab to carriage return, lower-cased.

    ``starts``/``ends`` are byte positions, ``doc`` the row of each word. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, separators: bytes = b" \t\n\x0b\x0c\r"):
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        self.offsets, self.data, self.rows = offsets - offsets[0], data, len(texts)
        table = np.ones(257, bool)
        table[list(separators)] = False
        inside = table[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.rows)
        self._sums = None

    def hashes(self, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``length`` bytes (of the whole word if shorter)."""
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(self.data))
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            self._back = _powers(_INVERSE, len(self.data))[self.starts]
        ends = self.ends if length is None else np.minimum(self.starts + length, self.ends)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._back)


def shingle_keys(words: Words, k: int) -> np.ndarray:
    """Sorted uint64 keys ``row << 48 | hash48`` of every run of k words, repeats kept; rows must be under 65536.

    A row with fewer words than k, but at least one, has a single shingle of all its words.
    """
    if words.rows >= 1 << 16:
        raise ValueError("too many rows in one call")
    h, doc = words.hashes(), words.doc.astype(np.uint64)
    out = []
    n = len(h) - k + 1
    if n > 0:
        roll = h[:n].copy()
        for i in range(1, k):
            roll = roll * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
        keep = doc[:n] == doc[k - 1 : k - 1 + n]
        out.append((doc[:n][keep] << np.uint64(48)) | (mix(roll[keep]) >> np.uint64(16)))
    first = np.cumsum(words.counts) - words.counts
    for row in np.flatnonzero((words.counts > 0) & (words.counts < k)):
        x = np.uint64(words.counts[row])
        for w in h[first[row] : first[row] + words.counts[row]]:
            with np.errstate(over="ignore"):
                x = x * np.uint64(0xD6E8FEB86659FD93) + w
        out.append((np.array([row], np.uint64) << np.uint64(48)) | (mix(np.array([x], np.uint64)) >> np.uint64(16)))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))
