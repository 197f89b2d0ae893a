"""Vectorised words, word hashes, shingles and windows over a batch of texts.

A word is a run of bytes other than space and U+0009 to U+000D, which is the pattern ``[^\\x20\\x09-\\x0D]+`` on code
points because UTF-8 never uses those bytes inside a longer character. A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation other than the underscore: for tokens rather than words.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "_"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0xD1342543DE82EF95)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _grown(name: str, base: U64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * have[done - 1 : done] * base
            done += step
        if size <= 1 << 22:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Words:
    """The words of a batch of texts: byte spans, owner, and a 64-bit hash of each."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True, second: bool = False, separators: np.ndarray = _SPACE):
        n = len(texts)
        if texts.type != pa.string():
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if texts.null_count:
            valid = np.asarray(texts.is_valid())
            lengths = np.where(valid, np.diff(offsets), 0)
            if (lengths != np.diff(offsets)).any():
                data = np.concatenate([data[a : a + m] for a, m in zip(offsets[:-1], lengths)] or [data[:0]])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.data, self.offsets = data, offsets
        solid = ~separators[data]
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            first[edges] |= solid[edges]
            last[edges - 1] |= solid[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: bounds[d]:bounds[d + 1] are the words of text d.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        if hashes:
            bytes_ = _LOWER[data] if lower else data
            self.hash = self._hash(_BYTE, bytes_)
            if second:
                self.hash2 = self._hash(_BYTE2, bytes_)

    def _hash(self, values: np.ndarray, data: np.ndarray) -> np.ndarray:
        m = len(data)
        total = np.empty(m + 1, U64)
        total[0] = 0
        np.multiply(values[data], _grown("up", _BASE, m), out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _grown("down", _BASE_INVERSE, max(m, 1))[self.starts]
        h += (self.ends - self.starts).astype(U64) * _ODD
        return mix(h)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, width: int, which: str = "hash") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every window of ``width`` words, with per-text bounds and the place of each window's first word."""
        h = getattr(self, which)
        counts = np.maximum(self.counts - width + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], counts)
        if not len(at):
            return np.zeros(0, U64), bounds, at
        if width <= 8:
            out = h[at] * _PLACE[0]
            for k in range(1, width):
                out += h[at + k] * _PLACE[k]
        else:
            m = len(h)
            total = np.zeros(m + 1, U64)
            np.cumsum(h * _grown("up", _BASE, m), out=total[1:])
            out = (total[at + width] - total[at]) * _grown("down", _BASE_INVERSE, m)[at]
        return mix(out + U64(width)), bounds, at

    def shingle_sets(self, width: int = 5) -> list[np.ndarray]:
        """Sorted distinct shingles of each text; fewer words than ``width`` make one shingle of the whole sequence."""
        h, bounds, _ = self.windows(width)
        out = []
        for d, words in enumerate(self.counts):
            if words >= width:
                s = np.sort(h[bounds[d] : bounds[d + 1]])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif words:
                part = self.hash[self.bounds[d] : self.bounds[d + 1]]
                out.append(mix(np.array([(part * _PLACE[: len(part)]).sum() + U64(words)], U64)))
            else:
                out.append(np.zeros(0, U64))
        return out
