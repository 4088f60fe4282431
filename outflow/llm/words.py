"""Words, word hashes and sequence hashes of many texts at once, on the byte buffer of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these never occur inside a longer UTF-8 character, so
bytes and characters agree. All hashes are sums over a ring of 64-bit integers followed by a mixing step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection of 64-bit integers)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


def odd(seed: int) -> int:
    """A pseudo-random odd 64-bit number that leaves the remainder 3 when divided by 8."""
    return (int(mix(np.array([seed * 2 + 1], np.uint64))[0]) & ~7) | 3


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a list of documents, in order; ``first[i]:first[i + 1]`` are those of document i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, *seeds: int) -> list[np.ndarray]:
        out = [np.empty(len(self.starts), np.uint64) for _ in seeds]
        at = 0
        while at < len(self.starts):
            # Whole words, about CHUNK bytes of them.
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + CHUNK)))
            begin, lens = self.starts[at:to], self.ends[at:to] - self.starts[at:to]
            base = np.cumsum(lens) - lens
            place = np.arange(int(lens.sum())) - np.repeat(base, lens)
            chars = self.data[place + np.repeat(begin, lens)]
            longest = int(lens.max())
            for seed, result in zip(seeds, out):
                letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(odd(seed + 7)))
                sums = np.add.reduceat(letters[chars] * powers(odd(seed), longest)[place], base)
                result[at:to] = mix(sums + lens.astype(np.uint64) * np.uint64(odd(seed + 13)))
            at = to
        return out


def split(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Words of every text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return Words(np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 2, np.zeros(1, np.int64))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid
    ends[:-1] = ends[:-1] & (SPACE[data[1:]] | cut[1:-1])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` consecutive hashes from each position on (of as many as there are places for)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    base = odd(seed + 29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n - width + 1)
    return mix((sums[width:] - sums[:-width]) * back + np.uint64(width))


def window_starts(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n - width + 1 windows lie inside one document."""
    inside = np.zeros(max(0, n - width + 1), bool)
    if not len(inside):
        return inside
    step = np.zeros(n + 1, np.int64)
    begin, end = first[:-1], first[1:] - width + 1
    held = end > begin
    np.add.at(step, begin[held], 1)
    np.add.at(step, end[held], -1)
    return np.cumsum(step)[: len(inside)] > 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space."""
    number = np.concatenate([[0], np.cumsum(keep)])
    starts, lens = words.starts[keep], (words.ends - words.starts)[keep]
    out = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    ahead = np.concatenate([[0], np.cumsum(lens + 1)])
    at = 0
    while at < len(lens):
        to = min(len(lens), max(at + 1, int(np.searchsorted(ahead, ahead[at] + CHUNK))))
        part = lens[at:to]
        place = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
        out[np.repeat(ahead[at:to], part) + place] = words.data[np.repeat(starts[at:to], part) + place]
        at = to
    rank = number[words.first]
    # Drop the space after each document's last word.
    tail = ahead[rank[1:]][rank[1:] > rank[:-1]] - 1
    solid = np.ones(len(out), bool)
    solid[tail] = False
    gone = np.concatenate([[0], np.cumsum(~solid)])
    offsets = ahead[rank] - gone[ahead[rank]]
    return pa.LargeStringArray.from_buffers(len(rank) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[solid]))
