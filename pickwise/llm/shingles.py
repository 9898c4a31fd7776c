"""Word shingles of whole texts as 64-bit numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of a number's first bytes
LONG = 64  # bytes of a word that is hashed by itself


def mixed(h: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ more) * _MULTIPLIERS[k % 8]
    h ^= h >> np.uint64(29)
    return h


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words of lower-cased text that has a space before it and eight behind it: all words side by
    side, eight bytes at a time."""
    space = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    at, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each place on
    h = mixed(size.astype(np.uint64) * _MULTIPLIERS[7], eight[at] & _FIRST[np.minimum(size, 8)], 1)
    own = np.flatnonzero(size > 8)
    for done in range(8, LONG, 8):
        if not len(own):
            break
        h[own] = mixed(h[own], eight[at[own] + done] & _FIRST[np.minimum(size[own] - done, 8)], done // 8 + 1)
        own = own[size[own] > done + 8]
    for i in own.tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + size[i]])
    h *= _MULTIPLIERS[0]
    return at, h ^ (h >> np.uint64(32))


def shingle_sets(texts: Sequence[bytes | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `words`-word shingles; of all its words as one shingle where there are fewer;
    empty without words.

    Words are what stands between U+0009-U+000D and U+0020, A-Z lower-cased: what bytes.lower() and bytes.split() do.
    """
    own = [t or b"" for t in texts]
    at, h = word_hashes(b" " + b" ".join(own).lower() + b" " * 8)
    starts = np.cumsum([1, *(len(t) + 1 for t in own)])
    first = np.searchsorted(at, starts)
    n = np.diff(first)
    with np.errstate(over="ignore"):

        def joined(at: np.ndarray | slice, k: int) -> np.ndarray:
            """Hashes of the k words from each place on."""
            s = np.uint64(k)
            for i in range(k):
                s = mixed(s, h[i : len(h) - k + 1 + i][at] if isinstance(at, slice) else h[at + i], i)
            s = s * _MULTIPLIERS[0]
            return s ^ (s >> np.uint64(32))

        every = joined(slice(None), words) if len(h) >= words else np.zeros(0, dtype=np.uint64)
        out = [np.zeros(0, dtype=np.uint64)] * len(own)
        for k in range(1, words):
            few = np.flatnonzero(n == k)
            if len(few):
                for i, s in zip(few.tolist(), joined(first[few], k), strict=True):
                    out[i] = np.array([s], dtype=np.uint64)
    for i in np.flatnonzero(n >= words).tolist():
        s = np.sort(every[first[i] : first[i + 1] - words + 1])
        new = np.ones(len(s), dtype=bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        out[i] = s[new]
    return out


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return shingle_sets([text], words)[0]
