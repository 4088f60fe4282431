"""Counting keys over the whole corpus and telling every group of documents the counts of its own keys.

Documents are dealt into groups of bounded size. Each group sends its sorted keys, as compressed lists, to the
shards that own the key ranges; a shard adds the lists up and answers each group with one value per key sent, in
the same order. So neither a key, however frequent, nor a count table ever has to fit into one place: a group
sends a key once, and what moves is about one to two bytes a key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.llm.words import mix

GROUP_BYTES = 4 << 20
SHARD_KEYS = 4 << 20

LISTS = "shard int, grp int, n int, low binary, high binary, counts binary"
ANSWERS = "grp int, shard int, answer binary"


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def group_count(total_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / GROUP_BYTES))


def hash_group(groups: int, *key: str) -> Column:
    """A group by hash; with the text among the keys, rows of one id spread over many."""
    return F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int")


class Sketch:
    """Sizes of a sharded sketch: ``rows`` independent rows, each with about ``spare`` cells per expected key."""

    def __init__(self, keys: float, rows: int = 1, spare: int = 8):
        self.rows = rows
        self.shard_bits = max(0, math.ceil(math.log2(max(1.0, keys / SHARD_KEYS))))
        per_shard = max(1024.0, keys / (1 << self.shard_bits))
        self.cell_bits = min(31, math.ceil(math.log2(per_shard * spare)))

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """The cell of each key in a row; its leading bits name the shard."""
        moved = mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64)))
        bits = self.shard_bits + self.cell_bits
        cells = moved >> np.uint64(64 - bits)
        return cells.astype(np.uint32) if bits <= 32 else cells

    def lists(self, grp: int, keys: np.ndarray) -> Iterator[tuple]:
        """Rows of LISTS: the cells that the keys of a group fall into, with counts up to 255."""
        for row in range(self.rows):
            cells, counts = np.unique(self.cells(keys, row), return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            for shard, a, b in self._shards(cells):
                own = cells[a:b].astype(np.int64) - (shard << self.cell_bits)
                gaps = np.diff(own, prepend=0)
                yield (
                    (row << self.shard_bits) + shard, grp, b - a, (gaps & 255).astype(np.uint8).tobytes(),
                    zlib.compress((gaps >> 8).astype(np.uint32).tobytes(), 1), zlib.compress(counts[a:b].tobytes(), 1),
                )

    def _shards(self, cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
        edges = np.searchsorted(cells, np.arange((1 << self.shard_bits) + 1, dtype=np.uint64) << np.uint64(self.cell_bits))
        for shard in np.flatnonzero(np.diff(edges)):
            yield int(shard), int(edges[shard]), int(edges[shard + 1])

    def merger(self, answer: Callable[[np.ndarray], bytes]) -> Callable[[pa.Table], pa.Table]:
        """For applyInArrow over the lists of one shard: totals per cell, then each group's answer."""
        width = 1 << self.cell_bits

        def merge(table: pa.Table) -> pa.Table:
            totals = np.zeros(width, np.uint16)
            cells = []
            for low, high, counts in zip(*(table.column(c).to_pylist() for c in ("low", "high", "counts"))):
                gaps = np.frombuffer(low, np.uint8) + (np.frombuffer(zlib.decompress(high), np.uint32).astype(np.int64) << 8)
                own = np.cumsum(gaps).astype(np.uint32)
                more = totals[own].astype(np.uint32) + np.frombuffer(zlib.decompress(counts), np.uint8)
                totals[own] = np.minimum(more, 65535).astype(np.uint16)
                cells.append(own)
            answers = [answer(totals[own]) for own in cells]
            return pa.table({"grp": table.column("grp").cast(pa.int32()), "shard": table.column("shard").cast(pa.int32()), "answer": pa.array(answers, pa.binary())})

        return merge

    def answers(self, cells: np.ndarray, row: int, table: pa.Table, read: Callable[[bytes, int], np.ndarray]) -> np.ndarray:
        """What the shards said about the sorted distinct cells of a row, one value per cell."""
        found = {s: a for s, a in zip(table.column("shard").to_pylist(), table.column("answer").to_pylist())}
        parts = [read(found[(row << self.shard_bits) + shard], b - a) for shard, a, b in self._shards(cells)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def pack_bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def read_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8), count=n)


def to_table(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in types]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names.split(), columns, types)})


LIST_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
LIST_NAMES = "shard grp n low high counts"
