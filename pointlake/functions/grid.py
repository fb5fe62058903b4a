"""Exact neighbours among points in memory: sorted grid keys at several cell sizes, vectorised.

Points of many blocks are held together; a block is searched by itself. Cells of a level are cubes of the block's unit times a
power of ``STEP``. A query is answered at the first level at which its own cell is populated enough for its k neighbours to lie
within a cell's width, so dense and sparse places are both met with few candidates.
"""

from __future__ import annotations

import numpy as np

#: Candidate pairs compared at a time, and cells more crowded than that start the search at finer levels.
PAIRS, CROWDED = 1_000_000, 64
#: How much wider the cells of a level are than those of the one before.
STEP = 2**0.5


def spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, all of first[i] .. first[i]+size[i]-1: (i, value) pairs."""
    who = np.repeat(np.arange(len(size)), size)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


class Grid:
    """Members ``xyz`` with ids ``pid`` in blocks 0..; ``unit`` is the cell size of each block."""

    def __init__(self, block: np.ndarray, xyz: np.ndarray, pid: np.ndarray, unit: np.ndarray) -> None:
        self.block, self.xyz, self.pid, self.unit = block.astype(np.int64), xyz, pid, unit
        self.origin = np.full((len(unit), 3), np.inf)
        np.minimum.at(self.origin, self.block, xyz)
        self.origin[~np.isfinite(self.origin)] = 0.0
        self.u = (xyz - self.origin[self.block]) / unit[self.block][:, None]
        self.most = float(self.u.max()) if len(xyz) else 0.0
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.columns: dict[int, tuple[np.ndarray, ...]] = {}
        self.coarsest = max(0, int(np.ceil(np.log(max(self.most, 1e-9)) / np.log(STEP))) + 1)
        room = (62 - max(1, int(len(unit)).bit_length())) // 3
        fits = lambda j: int(self.most / STEP**j + 3).bit_length() + 1 <= room
        self.finest = next(j for j in range(-6, self.coarsest + 128) if fits(j))
        self.coarsest = max(self.coarsest, self.finest)
        while len(xyz) and fits(self.finest - 4) and self.finest > -80 and self._crowd() > CROWDED:
            self.finest -= 4

    def _crowd(self) -> int:
        keys = self.level(self.finest)[0]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        return int(np.diff(edges).max())

    def level(self, j: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted keys of the members' cells, the members in that order, and the bits of an axis."""
        if j not in self.levels:
            cell = np.floor(self.u / STEP**j).astype(np.int64) + 2
            bits = int(self.most / STEP**j + 3).bit_length() + 1
            key = self._pack(self.block, cell, bits)
            order = np.argsort(key, kind="stable")
            self.levels[j] = key[order], order, bits
            self.columns[j] = tuple(np.ascontiguousarray(self.xyz[order, a]) for a in range(3))
        return self.levels[j]

    @staticmethod
    def _pack(block: np.ndarray, cell: np.ndarray, bits: int) -> np.ndarray:
        return ((block << bits | cell[:, 0]) << bits | cell[:, 1]) << bits | cell[:, 2]

    def _ranges(self, block: np.ndarray, u: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """First candidates and their numbers (queries, 9): nine columns of three cells around each query."""
        keys, _, bits = self.level(j)
        cell = np.clip(np.floor(u / STEP**j) + 2, 1, (1 << bits) - 2).astype(np.int64)
        key = self._pack(block, cell, bits)
        first, size = np.empty((len(key), 9), dtype=np.int64), np.empty((len(key), 9), dtype=np.int64)
        for n, (dx, dy) in enumerate((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            at = key + (((dx << bits) + dy) << bits)
            first[:, n] = np.searchsorted(keys, at - 1)
            size[:, n] = np.searchsorted(keys, at + 1, side="right") - first[:, n]
        return first, size

    def _squares(self, j: int, place: np.ndarray, xyz: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distances of members, given by their places in a level, to queries."""
        out = np.zeros(len(place))
        for a in range(3):
            d = self.columns[j][a][place]
            d -= xyz[:, a][q]
            d *= d
            out += d
        return out

    def _places(self, block: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        return (xyz - self.origin[block]) / self.unit[block][:, None]

    def nearest(self, block: np.ndarray, xyz: np.ndarray, k: int, own: np.ndarray | None = None, apart: bool = False, limit: float = np.inf, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, squared distance) of the k nearest, in order, ties to the smaller id; and which queries are settled.

        ``own`` are ids that are no neighbours of their query, ``apart`` leaves out members at the query's place, ``limit`` is
        the largest distance (inclusive). A query is settled if its k neighbours lie within ``reach``, by default any distance;
        one that is not settled has no rows.
        """
        block = block.astype(np.int64)
        n = len(xyz)
        done = np.zeros(n, dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = np.arange(n) if k > 0 and len(self.xyz) else np.empty(0, dtype=np.int64)
        if not len(todo):
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0), np.full(n, reach is None) if reach is None else ~np.isfinite(reach)
        u, size = self._places(block, xyz), self.unit[block]
        reach = np.full(n, np.inf) if reach is None else reach
        need = -(-(k + 1) // 3)
        for j in range(self.finest, self.coarsest + 1):
            keys, order, bits = self.level(j)
            sure = size[todo] * STEP**j * (1 - 1e-9)
            settles = (sure >= limit) | (sure >= reach[todo])
            if j == self.coarsest:
                pick = np.ones(len(todo), dtype=bool)
            else:
                cell = np.clip(np.floor(u[todo] / STEP**j) + 2, 1, (1 << bits) - 2).astype(np.int64)
                key = self._pack(block[todo], cell, bits)
                pick = (np.searchsorted(keys, key, side="right") - np.searchsorted(keys, key) >= need) | settles
            if not pick.any():
                continue
            asked, sure, settles = todo[pick], sure[pick], settles[pick]
            if j == self.coarsest:
                # whole blocks
                first = np.searchsorted(keys, block[asked] << (3 * bits))[:, None]
                count = np.searchsorted(keys, (block[asked] + 1) << (3 * bits))[:, None] - first
                bound = np.where(np.isfinite(reach[asked]), reach[asked], np.inf) ** 2
                settles = np.ones(len(asked), dtype=bool)
            else:
                first, count = self._ranges(block[asked], u[asked], j)
                bound = np.minimum(sure, reach[asked]) ** 2
            bound = np.where((sure >= limit) | (bound > limit * limit), limit * limit, bound)
            ends = np.cumsum(count.sum(axis=1))
            over = np.zeros(len(asked), dtype=bool)
            at = 0
            while at < len(asked):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                who, place = spans(first[at:stop].ravel(), count[at:stop].ravel())
                q = who // first.shape[1] + at
                d2 = self._squares(j, place, xyz[asked], q)
                ok = np.flatnonzero(d2 <= bound[q])
                q, m, d2 = q[ok], order[place[ok]], d2[ok]
                if own is not None or apart:
                    ok = (self.pid[m] != own[asked[q]]) if own is not None else np.ones(len(q), dtype=bool)
                    if apart:
                        ok &= d2 > 0
                    q, m, d2 = q[ok], m[ok], d2[ok]
                full = np.bincount(q - at, minlength=stop - at) >= k
                # all within the limit have been seen; or, in a whole block of unbounded reach, all there are
                full |= (sure[at:stop] >= limit) if j < self.coarsest else ~np.isfinite(reach[asked[at:stop]]) | (reach[asked[at:stop]] >= limit)
                over[at:stop] = full
                kept = full[q - at]
                q, m, d2 = q[kept], m[kept], d2[kept]
                rank = np.lexsort((self.pid[m], d2, q))
                q, m, d2 = q[rank], m[rank], d2[rank]
                start = np.searchsorted(q, np.arange(at, stop))
                best = np.arange(len(q)) - start[q - at] < k
                found.append((asked[q[best]], m[best], d2[best]))
                at = stop
            done[asked[over]] = True
            left = ~pick
            left[np.flatnonzero(pick)[~over & ~settles]] = True
            todo = todo[left]
            if not len(todo):
                break
        q, m, d2 = (np.concatenate(x) if found else np.empty(0, dtype=t) for x, t in zip(zip(*found) if found else ((),) * 3, (np.int64, np.int64, float)))
        return q, m, d2, done

    def within(self, block: np.ndarray, xyz: np.ndarray, radius: float):
        """Chunks (query, member, squared distance) of all members at most ``radius`` away; the units must be at least the radius."""
        block = block.astype(np.int64)
        if not len(self.xyz) or not len(xyz):
            return
        j = max(0, self.finest)
        order = self.level(j)[1]
        first, count = self._ranges(block, self._places(block, xyz), j)
        ends = np.cumsum(count.sum(axis=1))
        at = 0
        while at < len(xyz):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            who, place = spans(first[at:stop].ravel(), count[at:stop].ravel())
            q = who // 9 + at
            d2 = self._squares(j, place, xyz, q)
            ok = np.flatnonzero(d2 <= radius * radius)
            yield q[ok], order[place[ok]], d2[ok]
            at = stop
