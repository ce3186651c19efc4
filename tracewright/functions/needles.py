"""Which texts contain any of many: a rolling hash of every place against sorted hashes of the needles, then the bytes themselves."""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; bounds the memory of a worker whatever the length of a text.
STEP = 1 << 18
#: Bytes of a needle that are hashed; of longer ones the rest is compared only.
HASHED = 1024

_VALUES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for all places of a step."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(STEP + HASHED, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 2**64)))


class _Bitmap:
    """16 bits a hash, one of them set: others pass once in 16 times."""

    def __init__(self, hashes: np.ndarray):
        bits = max(10, int(16 * len(hashes)).bit_length())
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << bits - 3, np.uint8)
        at = hashes >> self.shift
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Which of ``h`` may be there."""
        at = h >> self.shift
        return np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


class _Hashes(_Bitmap):
    """Sorted hashes behind their bitmap."""

    def __init__(self, ordered: np.ndarray):
        super().__init__(ordered)
        self.ordered = ordered

    def among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are there, the first place of each in order)."""
        maybe = self.maybe(h)
        first = np.searchsorted(self.ordered, h[maybe])
        found = self.ordered[np.minimum(first, len(self.ordered) - 1)] == h[maybe]
        return maybe[found], first[found]


class Needles:
    """Distinct needles, not empty, by length; some 10 bytes each and their own, in a handful of arrays.

    A place of a text is looked at with needles of 2**k up to 2**(k+1) bytes only if the 2**k bytes there may begin one, which is
    asked in turn from the least k on, so lengths cost little where nothing begins. What has a needle's hash is compared with it.
    """

    def __init__(self, needles: list[bytes]):
        self.lengths: list[tuple[int, np.ndarray, _Hashes, int]] = []  # (bytes, needles as rows, hashes, most needles of one hash)
        begin: dict[int, list[np.ndarray]] = {}
        least = min(map(_level, map(len, needles)))
        for n, own in groupby(sorted(needles, key=len), len):
            rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)
            g = min(n, HASHED)
            levels = [1 << k for k in range(least.bit_length() - 1, _level(n).bit_length())]
            h = np.empty((len(rows), len(levels) + 1), np.uint64)
            for i in range(0, len(rows), part := max(1, STEP // g)):
                h[i : i + part] = np.cumsum(_VALUES[rows[i : i + part, :g]] * _powers()[0][:g], axis=1)[:, [x - 1 for x in (*levels, g)]]
            for k, x in enumerate(levels):
                begin.setdefault(x, []).append(np.unique(h[:, k]))
            order = np.argsort(h[:, -1])
            own_h = h[order, -1]
            self.lengths.append((n, rows[order], _Hashes(own_h), int(np.unique(own_h, return_counts=True)[1].max())))
        self.levels = [(x, _Bitmap(np.unique(np.concatenate(begin[x])))) for x in sorted(begin)]

    def inside(self, cells: pa.Array) -> np.ndarray:
        """Whether each cell has any needle; A-Z in cells count as a-z, a null cell has none."""
        cells = pc.fill_null(cells.cast(pa.large_binary()), b"")
        done = np.zeros(len(cells), bool)
        if not len(cells):
            return done
        ends = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
        data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        for low in range(0, len(data), STEP):
            self._step(data, ends, low, done)
        return done

    def _step(self, data: np.ndarray, ends: np.ndarray, low: int, done: np.ndarray) -> None:
        """Marks in ``done`` the cells with a needle that begins in the step of ``data`` at ``low``."""
        part = _FOLD[data[low : low + STEP + HASHED]]
        powers, inverse = _powers()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[part] * powers[: len(part)])])
        at = np.arange(min(STEP, len(data) - low))
        row = np.searchsorted(ends, low + at, "right") - 1
        room = ends[row + 1] - low - at  # bytes up to the cell's end
        hashed = lambda at, n: (sums[at + n] - sums[at]) * inverse[at]
        for level, begins in self.levels:
            keep = np.flatnonzero((room >= level) & ~done[row])
            keep = keep[begins.maybe(hashed(at[keep], level))]
            at, row, room = at[keep], row[keep], room[keep]
            if not len(at):
                return
            for n, rows, hashes, most in self.lengths:
                if _level(n) == level:
                    fits = np.flatnonzero((room >= n) & ~done[row])
                    found, first = hashes.among(hashed(at[fits], min(n, HASHED)))
                    self._compare(data, low + at[fits[found]], row[fits[found]], n, rows, hashes.ordered, first, most, done)

    @staticmethod
    def _compare(data, at, row, n, rows, ordered, first, most, done) -> None:
        """Places ``at`` have the hash of the needle ``first``, and maybe of ``most`` - 1 after it."""
        for i in range(0, len(at), part := max(1, STEP // n)):
            own = slice(i, i + part)
            for k in range(most):
                same = np.flatnonzero(~done[row[own]] & (first[own] + k < len(ordered)))
                same = same[ordered[first[own][same] + k] == ordered[first[own][same]]]
                if not len(same):
                    break
                texts = _FOLD[np.lib.stride_tricks.sliding_window_view(data, n)[at[own][same]]]
                done[row[own][same[(texts == rows[first[own][same] + k]).all(1)]]] = True


def _level(n: int) -> int:
    """The greatest power of two that is at most ``n``, up to the bytes that are hashed."""
    return 1 << min(n, HASHED).bit_length() - 1
