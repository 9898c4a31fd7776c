"""Deep-shallow suffix sorting in numpy.

Shallow: multikey quicksort with eight bytes as one symbol, all open groups at once; suffixes that agree go on to the next
symbol. Deep: what still agrees after SHALLOW symbols is ordered by blind tries (bitwise tries that hold only the
positions at which suffixes part): each suffix descends by the bits that the trie asks for, is compared once with the
leaf it meets, and is put in where the first difference says. All groups' tries grow side by side, one suffix a group and
round. Groups too large for that go on by symbols until they are small.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 3  # symbols of eight bytes
TRIE = 128  # most suffixes in a blind trie


def symbols(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The eight bytes from each position as one number, the first byte highest, and n: position p stands at p % 8 * n + p // 8,
    so the symbols of one suffix lie side by side."""
    n = len(text) // 8 + 1
    wide = np.concatenate([text, np.zeros(8 * n + 8 - len(text), dtype=np.uint8)])
    return np.concatenate([wide[i : i + 8 * n].view(">u8").astype(np.uint64) for i in range(8)]), n


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of 64-bit numbers that are not 0: from the exponent as floating point, for which the bit below the highest is cleared
    (so that none is rounded up)."""
    return 1086 - ((x & ~(x >> np.uint64(1))).astype(np.float64).view(np.int64) >> 52)


class Tries:
    """Blind tries of groups of suffixes that agree in `level` symbols and lie side by side; first: each one's first symbol
    among `words`; lo, size: each group's place, the largest first."""

    def __init__(self, words: np.ndarray, text: np.ndarray, starts: np.ndarray, first: np.ndarray, lo: np.ndarray, size: np.ndarray, level: int, depth: int):
        self.words, self.text, self.starts, self.first, self.depth = words, text, starts, first, depth
        self.lo, self.size, self.level = lo, size, level
        n = len(starts)
        self.bit = np.zeros(n, dtype=np.int32)  # of inner nodes: the position of the first differing bit
        self.child = np.zeros((2, n), dtype=np.int64)  # inner nodes from 0, leaves as ~member
        self.root = ~lo  # the first member of each group is its first leaf
        self.leaf = np.arange(n)  # the leaf that stands for a member: itself, or an equal one before
        for r in range(1, int(size.max(initial=0))):
            self.insert(r, int(np.searchsorted(-size, -r, side="left")))

    def asked(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (self.text[at + (bit >> 3)] >> (7 - (bit & 7)).astype(np.uint8)) & 1

    def insert(self, r: int, groups: int) -> None:
        """Member r of each of the first `groups` groups."""
        x = self.lo[:groups] + r
        at = self.starts[x]
        node = self.root[:groups].copy()
        down = np.flatnonzero(node >= 0)
        while len(down):
            v = node[down]
            v = self.child[self.asked(at[down], self.bit[v]), v]
            node[down] = v
            down = down[v >= 0]
        met = ~node
        differ = np.full(groups, self.depth * 8, dtype=np.int64)
        same, own, other = np.arange(groups), self.first[x], self.first[met]
        for k in range(self.level, -(-self.depth // 8)):
            x_or = self.words[own + k] ^ self.words[other + k]
            apart = np.flatnonzero(x_or)
            if len(apart):
                differ[same[apart]] = np.minimum(k * 64 + leading_zeros(x_or[apart]), self.depth * 8)
                on = np.flatnonzero(x_or == 0)
                same, own, other = same[on], own[on], other[on]
            if not len(same):
                break
        equal = differ >= self.depth * 8
        self.leaf[x[equal]] = met[equal]
        g = np.flatnonzero(~equal)
        if not len(g):
            return
        x, at, differ = x[g], at[g], differ[g]
        above, side, node = np.full(len(g), -1, dtype=np.int64), np.zeros(len(g), dtype=np.int64), self.root[g].copy()
        down = np.arange(len(g))
        while len(down):
            v = node[down]
            inner = v >= 0
            down, v = down[inner], v[inner]
            go = self.bit[v] < differ[down]
            down, v = down[go], v[go]
            turn = self.asked(at[down], self.bit[v])
            above[down], side[down] = v, turn
            node[down] = self.child[turn, v]
        own = self.asked(at, differ).astype(np.int64)
        new = x  # a member's own place names the node that it brings
        self.bit[new] = differ
        self.child[own, new], self.child[1 - own, new] = ~x, node
        top = above < 0
        self.root[g[top]] = new[top]
        self.child[side[~top], above[~top]] = new[~top]

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member's rank among its group's leaves, and the bytes that the leaf shares with the one before it."""
        n, groups = len(self.starts), len(self.lo)
        rank, shared = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        stack, carried = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        stack[self.lo] = self.root
        height, nth = np.ones(groups, dtype=np.int64), np.zeros(groups, dtype=np.int64)
        live = np.arange(groups)
        while len(live):
            height[live] -= 1
            place = self.lo[live] + height[live]
            node, before = stack[place], carried[place]
            leaf = node < 0
            g, m = live[leaf], ~node[leaf]
            rank[m], shared[m] = nth[g], before[leaf]
            nth[g] += 1
            g, v, place, before = live[~leaf], node[~leaf], place[~leaf], before[~leaf]
            stack[place], carried[place] = self.child[1, v], self.bit[v] >> 3
            stack[place + 1], carried[place + 1] = self.child[0, v], before
            height[g] += 2
            live = live[height[live] > 0]
        return rank, shared


def ordered(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts` by their first `depth` bytes (equal ones by start), and the bytes, up to
    `depth`, that each shares with the one before it in that order.

    text: uint8; every suffix has `depth` bytes at least. No suffixes give empty arrays.
    """
    n = len(starts)
    shared = np.zeros(n, dtype=np.int64)
    if not n:
        return np.zeros(0, dtype=np.int64), shared
    text = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
    words, n_words = symbols(text)
    by_start = np.argsort(starts, kind="stable")
    starts = starts[by_start]
    at = (starts & 7) * n_words + (starts >> 3)
    order = np.arange(n)
    # Open groups: places in the order, side by side, and each group's first index among them.
    places, first, level = np.arange(n), np.zeros(1, dtype=np.int64), 0
    deep: list[tuple[np.ndarray, np.ndarray, int]] = []
    while len(places) and level * 8 < depth:
        key = words[at[order[places]] + level]
        over = level * 8 + 8 - depth
        if over > 0:
            key = key >> np.uint64(8 * over) << np.uint64(8 * over)
        by = np.argsort(key)
        head = np.zeros(len(places), dtype=bool)
        head[first] = True
        if len(first) > 1:  # then by group, which keeps its place
            group = np.cumsum(head) - 1
            by = by[within(group[by])]
        order[places] = order[places][by]
        key = key[by]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        split, inside = np.flatnonzero(new), np.flatnonzero(new & ~head)
        shared[places[inside]] = level * 8 + leading_zeros(key[inside] ^ key[inside - 1]) // 8
        level += 1
        size = np.diff(np.append(split, len(places)))
        small = (size <= TRIE) & (level >= SHALLOW) & (level * 8 < depth)
        if (small & (size > 1)).any():
            deep.append((*picked(places, size, small & (size > 1)), level))
        places, first = picked(places, size, ~small & (size > 1))
    rest = np.ones(len(places), dtype=bool)
    rest[first] = False
    shared[places[rest]] = depth  # groups that agree to the full depth
    order[places] = ascending(order[places], first)
    for where, lo, level in deep:
        settle(text, words, starts, at, order, shared, where, lo, level, depth)
    return by_start[order], shared


def within(group: np.ndarray) -> np.ndarray:
    """The stable order of group numbers: number and place are sorted as one."""
    return np.sort(group << 32 | np.arange(len(group))) & 0xFFFFFFFF


def ascending(members: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The members of each group, ascending."""
    head = np.zeros(len(members), dtype=np.int64)
    head[first] = 1
    return np.sort(np.cumsum(head) << 32 | members) & 0xFFFFFFFF


def picked(places: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the chosen groups, and each one's first index among them."""
    return places[np.repeat(chosen, size)], np.cumsum(size[chosen]) - size[chosen]


def settle(text: np.ndarray, words: np.ndarray, starts: np.ndarray, at: np.ndarray, order: np.ndarray, shared: np.ndarray, places: np.ndarray, first: np.ndarray, level: int, depth: int) -> None:
    """Order small groups that agree in `level` symbols by blind tries."""
    size = np.diff(np.append(first, len(places)))
    by = np.argsort(-size, kind="stable")
    members = ascending(order[places], first)
    tries = Tries(words, text, starts[members], at[members], first[by], size[by], level, depth)
    rank, common = tries.order()
    rank, common = rank[tries.leaf], np.where(tries.leaf == np.arange(len(places)), common[tries.leaf], depth)
    by = within(np.repeat(first, size) + rank)  # a group has no more ranks than members
    order[places] = members[by]
    heads = np.zeros(len(places), dtype=bool)
    heads[first] = True
    common = common[by]
    shared[places[~heads]] = common[~heads]
