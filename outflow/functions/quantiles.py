"""Exact quantiles and counts of many numeric columns by refined histograms.

One pass of approximate percentiles brackets every cut of every column; one pass counts the rows at and between the brackets'
edges, all columns at once; only the cells that still hold a cut are looked at again, and when few rows are left in them these are counted value by
value. Nothing is sorted or written, no column is turned into rows of its own but those few, and what reaches the driver is
bounded by columns, cuts and ``gather``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 5000


def _values(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The non-null values of a column."""
    return batch.column(i).drop_null().to_numpy(zero_copy_only=False)


def cell_counts(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> dict[str, np.ndarray]:
    """Per column the rows in its cells: 2 i below edge i and above the one before, 2 i + 1 at edge i. Edges ascend; nulls count nowhere."""
    names = list(edges)
    sorted_edges = [np.asarray(edges[n], float) for n in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(e) + 1, np.int64) for e in sorted_edges]
        for batch in batches:
            for i, (e, t) in enumerate(zip(sorted_edges, totals)):
                v = _values(batch, i)
                t += np.bincount(np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right"), minlength=len(t))
        rows = [(i, int(c), int(t[c])) for i, t in enumerate(totals) for c in np.flatnonzero(t)]
        column, cell, n = map(list, zip(*rows)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["column", "cell", "n"])

    plain = df.select(*[F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    out = {n: np.zeros(2 * len(e) + 1, np.int64) for n, e in zip(names, sorted_edges)}
    for r in plain.mapInArrow(count, "column int, cell int, n bigint").groupBy("column", "cell").agg(F.sum("n").alias("n")).collect():
        out[names[r.column]][r.cell] = r.n
    return out


def _inside(df: DataFrame, cells: Mapping[str, list[tuple[int, float, float]]]) -> DataFrame:
    """(column, cell, value) of the values strictly inside the given open cells."""
    names = list(cells)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int32),) * 2 + (np.zeros(0),)]
            for i, name in enumerate(names):
                v = _values(batch, i)
                for cell, low, high in cells[name]:
                    kept = v[(v > low) & (v < high)]
                    found.append((np.full(len(kept), i, np.int32), np.full(len(kept), cell, np.int32), kept))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["column", "cell", "value"])

    plain = df.select(*[F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    return plain.mapInArrow(pick, "column int, cell int, value double")


def exact_cuts(df: DataFrame, columns: Sequence[str], at: Sequence[float], gather: int = 100_000) -> dict[str, tuple[int, list[float]]]:
    """Per column its non-null rows and the linearly interpolated quantiles; a column without rows has none."""
    near = 2.0 / ACCURACY
    probes = sorted({min(1.0, max(0.0, q + d)) for q in at for d in (-near, 0.0, near)})
    numbers = {c: F.col(f"`{c}`").cast("double") for c in columns}
    first = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(numbers.values())],
        *[F.array_append(F.array_prepend(F.percentile_approx(v, probes, ACCURACY), F.min(v)), F.max(v)).alias(f"p{i}") for i, v in enumerate(numbers.values())],
    ).first()
    rows = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    edges = {c: sorted(set(first[f"p{i}"])) for i, c in enumerate(columns) if rows[c]}
    wanted = {c: sorted({r for q in at for r in (math.floor((rows[c] - 1) * q), math.ceil((rows[c] - 1) * q))}) for c in edges}
    found: dict[str, dict[int, float]] = {c: {} for c in edges}
    while True:
        counts = cell_counts(df, {c: edges[c] for c in edges if len(found[c]) < len(wanted[c])}) if any(len(found[c]) < len(wanted[c]) for c in edges) else {}
        open_cells: dict[str, dict[int, tuple[float, float, int, int]]] = {}
        for c, n in counts.items():
            upto = np.cumsum(n)
            for rank in wanted[c]:
                if rank in found[c]:
                    continue
                cell = int(np.searchsorted(upto, rank, "right"))
                if cell % 2:
                    found[c][rank] = edges[c][cell // 2]
                else:
                    # The least and greatest value are edges, so an open cell that holds a rank lies between two.
                    open_cells.setdefault(c, {})[cell] = (edges[c][cell // 2 - 1], edges[c][cell // 2], int(upto[cell - 1]), int(n[cell]))
        if not open_cells:
            break
        names = list(open_cells)
        left = _inside(df, {c: [(cell, low, high) for cell, (low, high, _, _) in cells.items()] for c, cells in open_cells.items()})
        if sum(n for cells in open_cells.values() for _, _, _, n in cells.values()) <= gather:
            held: dict[tuple[str, int], list[tuple[float, int]]] = {}
            for r in left.groupBy("column", "cell", "value").count().collect():
                held.setdefault((names[r.column], r.cell), []).append((r.value, r["count"]))
            for (c, cell), values in held.items():
                values.sort()
                ranks = open_cells[c][cell][2] + np.cumsum([n for _, n in values])
                for rank in wanted[c]:
                    if rank not in found[c] and open_cells[c][cell][2] <= rank < ranks[-1]:
                        found[c][rank] = values[int(np.searchsorted(ranks, rank, "right"))][0]
            break
        # More edges inside the open cells: the percentiles of what they hold.
        fine = [i / 16 for i in range(17)]
        for r in left.groupBy("column", "cell").agg(F.percentile_approx("value", fine, ACCURACY).alias("p")).collect():
            edges[names[r.column]] = sorted({*edges[names[r.column]], *r.p})
    out = {}
    for c in columns:
        places = [(rows[c] - 1) * q for q in at] if rows[c] else []
        lows, highs = ([found[c][f(p)] for p in places] for f in (math.floor, math.ceil))
        out[c] = rows[c], [low + (high - low) * (p - math.floor(p)) for low, high, p in zip(lows, highs, places)]
    return out
