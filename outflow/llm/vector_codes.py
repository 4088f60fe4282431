"""Compression of vectors to one code per part, with adaptive distance bounds (operator 13).

Method: every component becomes an integer, every vector is cut into parts, and each part position has a codebook found
by rounds of assignment and replacement. Distances are compared by Drake's and Hamerly's adaptive bounds: a part keeps, from one round
to the next, its entry with an upper bound of the distance, its b next closest entries with lower bounds in ascending
order, and one outer bound for all entries beyond these. When the entries move, the bounds move by as much. A part whose
upper bound is below all lower ones keeps its entry unseen; else its own distance is taken exactly, then those of its b
entries, and only if the outer bound does not clear these all entries. b is adapted per part position: the next
round keeps as many as all but a hundredth of the parts needed, an eighth of the entries at least.

Bounds are halved floats rounded to the safe side, so they can only be too loose. Whatever they leave open is settled in
64-bit integers, ties to the lower index; the codes are those of a full search. Between rounds the state is a written
table; sums are added up per task before they meet, and what the driver holds is the codebooks: entries x components.

Defined cases: a null vector, or one with a null or non-finite component, is left out, and so is an empty one and one whose
dimension is not that of the smallest id kept; components of 65,536 and more are held at 65,536, so that distances fit a
long. Null ids come last. Fewer vectors than entries make a smaller codebook. A
dimension that is no multiple of the parts is cut at floor(i * dimension / parts). Rows with one id are rows of their own; for the
start they are taken in the order of their components. Equal labels are added up together, null labels too. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.session import durable

SCALE, HELD = 256, 1 << 24
STATE = "vec_id bigint, label string, v array<int>, code binary, upper binary, outer binary, near binary, low binary, needed binary"
SAFE = 1e-6


@dataclass(frozen=True)
class Codes:
    """``rows``: vec_id, code, error, label_error. ``codebooks``: part -> entries x components. ``bounds``: per round, entries kept per part
    position and how many parts had to look at them."""

    rows: DataFrame
    codebooks: list[np.ndarray]
    bounds: list[dict]

    def codebooks_text(self) -> str:
        return ",".join(str(int(x)) for book in self.codebooks for entry in book for x in entry)

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(self.codebooks_text().encode()).hexdigest()


def down(x: np.ndarray) -> np.ndarray:
    """As 16-bit floats, none above its value."""
    with np.errstate(over="ignore"):
        h = np.minimum(x, 65504).astype(np.float16)
        return np.where(h > x, np.nextafter(h, np.float16(-np.inf)), h)


def up(x: np.ndarray) -> np.ndarray:
    """As 16-bit floats, none below its value."""
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
        return np.where(h < x, np.nextafter(h, np.float16(np.inf)), h)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, n x k, as integers; components one by one, so that nothing is larger than the result."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        gap = x[:, i, None] - entries[None, :, i]
        out += gap * gap
    return out


def own_square(x: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    gap = x - entries[at]
    return (gap * gap).sum(1)


def full(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """code, upper, outer, near, low of parts of which nothing is known yet."""
    d = squares(x, book)
    code = d.argmin(1)
    order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    # A stable order has the lowest index of the smallest distance in front, which is the code.
    near, low = order[:, 1 : b + 1], far[:, 1 : b + 1]
    outer = far[:, b + 1] if far.shape[1] > b + 1 else np.full(len(x), np.inf)
    return code, far[:, 0], outer, near, low


def moved(x: np.ndarray, book: np.ndarray, shift: np.ndarray, b: int, code: np.ndarray, upper: np.ndarray, outer: np.ndarray, near: np.ndarray, low: np.ndarray):
    """The same after the entries moved by ``shift``, with ``b`` entries kept, and how many of the entries kept each part needed."""
    n, held = near.shape
    upper = upper + shift[code]
    low = low - shift[near]
    outer = outer - (shift.max() if len(shift) else 0.0)
    least = np.minimum(low.min(1), outer) if held else outer
    unsure = np.flatnonzero(~(upper * (1 + SAFE) + SAFE < least))
    needed = np.zeros(n, np.uint8)
    if len(unsure):
        square = own_square(x[unsure], book, code[unsure])
        upper[unsure] = np.sqrt(square.astype(np.float64))
        still = ~(upper[unsure] * (1 + SAFE) + SAFE < least[unsure])
        unsure, square = unsure[still], square[still]
    if len(unsure):
        # The entry itself and those kept near, exactly; columns in the order of their index, so that ties fall to the lower one.
        own = np.concatenate([code[unsure, None], near[unsure]], axis=1)
        own.sort(axis=1)
        exact = np.stack([own_square(x[unsure], book, own[:, i]) for i in range(own.shape[1])], axis=1)
        order = np.argsort(exact, axis=1, kind="stable")
        own, far = np.take_along_axis(own, order, 1), np.sqrt(np.take_along_axis(exact, order, 1).astype(np.float64))
        needed[unsure] = np.minimum(255, (low[unsure] <= (upper[unsure] * (1 + SAFE) + SAFE)[:, None]).sum(1))
        code[unsure], upper[unsure] = own[:, 0], far[:, 0]
        near[unsure], low[unsure] = own[:, 1:], far[:, 1:]
        open_ = unsure[~(upper[unsure] * (1 + SAFE) + SAFE < outer[unsure])]
        if len(open_):
            needed[open_] = min(255, held + 1)
            code[open_], upper[open_], outer[open_], again, far = full(x[open_], book, held)
            near[open_, : again.shape[1]], low[open_, : again.shape[1]] = again, far
    order = np.argsort(low, axis=1, kind="stable")
    near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
    if b < held:
        # The outer bound covers the entries that go.
        outer = np.minimum(outer, low[:, b])
        near, low = near[:, :b], low[:, :b]
    return code, upper, outer, near, low, needed


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2
) -> Codes:
    """Codes, errors and codebooks after ``rounds`` rounds and a last assignment. At most 256 entries."""
    if not (0 < entries <= 256 and parts > 0 and rounds >= 0):
        raise ValueError("a code is one byte a part")
    whole = F.transform(F.col(embedding), lambda x: F.floor(F.greatest(F.lit(-float(HELD)), F.least(F.lit(float(HELD)), SCALE * x.cast("double")))).cast("int"))
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(sound).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), whole.alias("v")
    )
    # A bounded start: the vectors of the smallest ids.
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = len(first[0]) if first else parts
    first = [v for v in first if len(v) == width]
    if len(first) < entries and first:
        first = [r.v for r in kept.where(F.size("v") == width).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    kept = kept.where(F.size("v") == width)
    cuts = [i * width // parts for i in range(parts + 1)]
    start = np.array(first, np.int64).reshape(len(first), width)
    books = [start[:, a:z] for a, z in zip(cuts, cuts[1:])]
    kept_near = [max(0, min(len(first) - 1, max(1, len(first) // 4)))] * parts
    state = durable(kept.mapInArrow(_assigner(cuts, books, None, kept_near, kept_near), STATE))
    reports = []
    for turn in range(rounds):
        grown = _replaced(state, cuts, books)
        shifts = [np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)) for new, old in zip(grown, books)]
        books, before = grown, kept_near
        if turn:
            kept_near = [b if n is None or not b else min(b, max(1, len(first) // 8, n)) for b, n in zip(before, needs)]
        state = durable(state.mapInArrow(_assigner(cuts, books, shifts, before, kept_near), STATE))
        needs, looked = _needs(state, parts)
        reports.append({"kept": kept_near, "looked": looked})
    rows = state.mapInArrow(_errors(cuts, books), "vec_id bigint, label string, code string, error bigint")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error")
    return Codes(out, books, reports)


def _matrix(column: pa.ChunkedArray | pa.Array, dtype, *shape: int) -> np.ndarray:
    """A binary column of equal lengths as an array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    size = a.nbytes // len(a) if len(a) else 0
    offsets = np.arange(len(a) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(a.tobytes())])


def _ints(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigner(cuts: list[int], books: list[np.ndarray], shifts: list[np.ndarray] | None, before: list[int], after: list[int]) -> Callable:
    """From rows, or from the state that kept ``before`` entries per part, to the state that keeps ``after``."""
    parts, width = len(books), cuts[-1]
    edges = np.concatenate([[0], np.cumsum(before)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _ints(batch, width)
            if shifts is not None:
                old = [_matrix(batch.column(c), t, -1) for c, t in (("code", np.uint8), ("upper", np.float16), ("outer", np.float16))]
                near_all, low_all = (
                    _matrix(batch.column(c), t, int(edges[-1])) for c, t in (("near", np.uint8), ("low", np.float16))
                )
            out: list[tuple] = []
            for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if shifts is None:
                    code, upper, outer, near, low = full(x[:, a:z], books[p], after[p])
                    needed = np.zeros(n, np.uint8)
                else:
                    code, upper, outer = (c[:, p].astype(t) for c, t in zip(old, (np.int64, np.float64, np.float64)))
                    near, low = (c[:, edges[p] : edges[p + 1]].astype(t) for c, t in ((near_all, np.int64), (low_all, np.float64)))
                    code, upper, outer, near, low, needed = moved(x[:, a:z], books[p], shifts[p], after[p], code, upper, outer, near, low)
                out.append((code.astype(np.uint8), up(upper), down(outer), near.astype(np.uint8), down(low), needed))
            code, upper, outer = (np.stack([o[i] for o in out], axis=1) for i in range(3))
            near, low = (np.concatenate([o[i] for o in out], axis=1) for i in (3, 4))
            needed = np.stack([o[5] for o in out], axis=1)
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("v"), *map(_binary, (code, upper, outer, near, low, needed))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "code", "upper", "outer", "near", "low", "needed"])

    return assign


def _replaced(state: DataFrame, cuts: list[int], books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with every used entry at the floor of its parts' mean."""
    parts, width = len(books), cuts[-1]
    k = len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((k, z - a + 1), np.int64) for a, z in zip(cuts, cuts[1:])]
        for batch in batches:
            if batch.num_rows:
                x, code = _ints(batch, width), _matrix(batch.column("code"), np.uint8, parts)
                for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    np.add.at(totals[p], code[:, p], np.concatenate([x[:, a:z], np.ones((len(x), 1), np.int64)], axis=1))
        rows = [(p, e, i, int(t[e, i]), int(t[e, -1])) for p, t in enumerate(totals) for e in np.flatnonzero(t[:, -1]) for i in range(t.shape[1] - 1)]
        part, entry, place, total, count = map(list, zip(*rows)) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(total, pa.int64()), pa.array(count, pa.int64())],
            names=["part", "entry", "place", "total", "n"],
        )

    added = state.select("v", "code").mapInArrow(sums, "part int, entry int, place int, total bigint, n bigint")
    out = [book.copy() for book in books]
    # At most one row per entry and component.
    for r in added.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry, r.place] = r.total // r.n
    return out


def _needs(state: DataFrame, parts: int) -> tuple[list[int | None], list[int]]:
    """Per part position, how many entries all but a hundredth of the parts needed, and how many parts needed any."""
    at = [F.conv(F.hex(F.substring("needed", p + 1, 1)), 16, 10).cast("int") for p in range(parts)]
    row = state.agg(
        *[F.percentile_approx(n, 0.99, 1000).alias(f"p{p}") for p, n in enumerate(at)], *[F.count_if(n > 0).alias(f"n{p}") for p, n in enumerate(at)]
    ).first()
    return list(row[:parts]), list(row[parts:])


def _errors(cuts: list[int], books: list[np.ndarray]) -> Callable:
    parts, width = len(books), cuts[-1]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _ints(batch, width), _matrix(batch.column("code"), np.uint8, parts)
            total = np.zeros(len(x), np.int64)
            for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
                total += own_square(x[:, a:z], books[p], code[:, p].astype(np.int64))
            hexed = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(hexed, pa.string()), pa.array(total, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return errors
