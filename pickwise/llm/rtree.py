"""An R-tree over count vectors, joined with itself under an overlap bound.

A set of shingles is a point: its shingles are hashed into groups, coordinate g counts those in group g. Two sets share at
most sum_g min(a_g, b_g) shingles, and members of two tree nodes at most sum_g min(top_a_g, top_b_g), where top is the
upper corner of a node's box. Pairs of nodes whose bound falls short of the threshold are left, with all they hold.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
FOUR = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8).view(np.uint32).ravel()  # the four counts of a byte


def counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def groups_for(n: int) -> int:
    """About as many groups as the set has members: a power of two from 64 to 32768."""
    return 1 << max(6, min(15, max(n, 1).bit_length()))


def packed(vector: np.ndarray) -> bytes:
    """Counts as bytes: a shift, then each count over 2^shift, rounded up (so that bounds stay bounds)."""
    shift = max(0, int(vector.max(initial=0)).bit_length() - 8)
    if -(-int(vector.max(initial=0)) // (1 << shift)) > 255:
        shift += 1
    return bytes([shift]) + (-(-vector // (1 << shift))).astype(np.uint8).tobytes()


def packed_fine(vector: np.ndarray) -> bytes:
    """Counts in two bits each, up to 3, and after them (group, rest) of those above 3: exact. As bytes where that is shorter."""
    low = np.minimum(vector, 3).astype(np.uint8)
    over = np.flatnonzero(vector > 3).astype("<u4")
    rest = np.stack([over, vector[over].astype("<u4") - np.uint32(3)]).astype("<u4").tobytes()
    four = low[::4] | low[1::4] << 2 | low[2::4] << 4 | low[3::4] << 6
    out = b"\xff" + len(vector).to_bytes(4, "little") + four.tobytes() + rest
    return out if len(out) <= len(vector) else packed(vector)


def unpacked(raw: bytes) -> np.ndarray:
    if raw[0] < 255:
        return np.frombuffer(raw, dtype=np.uint8, offset=1).astype(np.int32) << raw[0]
    n = int.from_bytes(raw[1:5], "little")
    out = FOUR[np.frombuffer(raw, dtype=np.uint8, offset=5, count=n // 4)].view(np.uint8).astype(np.int32)
    if len(raw) > 5 + n // 4:
        over, rest = np.frombuffer(raw, dtype="<i4", offset=5 + n // 4).reshape(2, -1)
        out[over] += rest
    return out


def fits(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets of these sizes and packed vectors pass the bound, over the groups that both vectors have."""
    x, y = unpacked(a), unpacked(b)
    g = min(len(x), len(y))
    return int(np.minimum(fold(x, g), fold(y, g)).sum()) >= needed(na + nb, percent)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The counts over fewer groups (a power of two)."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def needed(total: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two sets of `total` shingles together: 100 * i >= percent * (total - i)."""
    return -(-(percent * total) // (100 + percent))


class Tree:
    """Bulk-loaded: the points are halved at the median of their widest coordinate until LEAF are left."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order: list[np.ndarray] = []

        def halve(idx: np.ndarray) -> None:
            stack = [idx]
            while stack:
                own = stack.pop()
                if len(own) <= LEAF:
                    order.append(own)
                    continue
                p = points[own]
                axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
                by = own[np.argsort(p[:, axis], kind="stable")]
                half = -(-len(by) // (2 * LEAF)) * LEAF
                if half >= len(by):
                    half = len(by) // 2
                stack += [by[half:], by[:half]]

        halve(np.argsort(sizes, kind="stable"))
        self.order = np.concatenate(order)
        self.starts = [np.concatenate([[0], np.cumsum([len(o) for o in order])])]
        p, s = points[self.order], sizes[self.order]
        self.tops = [np.maximum.reduceat(p, self.starts[0][:-1])]
        self.least = [np.minimum.reduceat(s, self.starts[0][:-1])]
        self.most = [np.maximum.reduceat(s, self.starts[0][:-1])]
        while len(self.tops[-1]) > 1:  # levels of LEAF children each
            n = len(self.tops[-1])
            at = np.arange(0, n, LEAF)
            self.starts.append(np.append(at, n))
            self.tops.append(np.maximum.reduceat(self.tops[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))

    def leaf_pairs(self, percent: int, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (a <= b) that may hold a pair over the threshold, from the root down."""
        a = b = np.zeros(1, dtype=np.int64)
        for level in range(len(self.tops) - 1, -1, -1):
            keep = []
            for lo in range(0, len(a), most):
                x, y = a[lo : lo + most], b[lo : lo + most]
                bound = np.minimum(self.tops[level][x], self.tops[level][y]).sum(axis=1)
                low = needed(self.least[level][x] + self.least[level][y], percent)
                near = (100 * self.most[level][x] >= percent * self.least[level][y]) & (100 * self.most[level][y] >= percent * self.least[level][x])
                keep.append(np.flatnonzero(near & (bound >= low)) + lo)
            k = np.concatenate(keep)
            a, b = a[k], b[k]
            if level:
                s = self.starts[level]
                x, y = expand(s[a], s[a + 1], s[b], s[b + 1])
                up = x <= y
                a, b = x[up], y[up]
        return a, b


def expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) with a0 <= x < a1 and b0 <= y < b1, for each row of the ranges."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[row] + k // nb[row], b0[row] + k % nb[row]


def survivors(points: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int, most: int = 20_000) -> np.ndarray:
    """Which pairs of points pass the size test and the bound."""
    out = np.zeros(len(x), dtype=bool)
    near = np.flatnonzero((100 * sizes[x] >= percent * sizes[y]) & (100 * sizes[y] >= percent * sizes[x]))
    for lo in range(0, len(near), most):
        k = near[lo : lo + most]
        out[k] = np.minimum(points[x[k]], points[y[k]]).sum(axis=1) >= needed(sizes[x[k]] + sizes[y[k]], percent)
    return out


def close(packs: list[bytes], sizes: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int, cells: int = 1_000_000) -> np.ndarray:
    """How many shingles each pair of members can share at most, by all the groups that both packed vectors have; -1 where
    that is too few. In slices of bounded memory, over few groups first: pairs that these rule out are not looked at over more."""
    out = np.full(len(x), -1, dtype=np.int64)
    groups = np.array([groups_for(int(n)) for n in sizes])
    least, need = np.minimum(groups[x], groups[y]), needed(sizes[x] + sizes[y], percent)
    for g in np.unique(least).tolist():
        own = np.flatnonzero(least == g)
        for lo in range(0, len(own), step := max(1, cells // g)):
            k = own[lo : lo + step]
            used, at = np.unique(np.concatenate([x[k], y[k]]), return_inverse=True)
            table = np.stack([fold(unpacked(packs[u]), g) for u in used])
            i, j = at[: len(k)], at[len(k) :]
            for few in sorted({min(g, 256), min(g, 1024), g}):
                t = table.reshape(len(used), -1, few).sum(axis=1, dtype=np.int32) if few < g else table
                t = t.astype(np.uint8) if t.max(initial=0) < 256 else t
                most = np.minimum(t[i], t[j]).sum(axis=1, dtype=np.int32)
                ok = most >= need[k]
                k, i, j, most = k[ok], i[ok], j[ok], most[ok]
            out[k] = most
    return out


def join(points: np.ndarray, sizes: np.ndarray, percent: int):
    """Yields (x, y) arrays of point numbers, x before y in the tree's order, that pass the bound."""
    t = Tree(points, sizes)
    a, b = t.leaf_pairs(percent)
    s = t.starts[0]
    for lo in range(0, len(a), 1024):
        p, q = a[lo : lo + 1024], b[lo : lo + 1024]
        x, y = expand(s[p], s[p + 1], s[q], s[q + 1])
        up = x < y
        x, y = t.order[x[up]], t.order[y[up]]
        ok = survivors(points, sizes, x, y, percent)
        yield x[ok], y[ok]
