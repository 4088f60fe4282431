"""Repair of the structure of conversations by the cheapest edits (operator 12).

Method: depth-first branch and bound. A node is a row and a state of the grammar (an optional system message, then pairs of
user and assistant); its branches are the edits Delete, Insert, Keep and Rerole. An explicit stack holds the open
branches. A suffix bound tells for every row and state the least cost of what is left when nothing but roles and required deletions
is looked at; a branch goes on only if its cost and that bound do not exceed the incumbent (cost, audit), and its audit is not
already larger at the same cost. A table per node keeps the best (cost, audit) that has reached it and cuts all worse
prefixes. The search ends when no branch is left, which proves the incumbent optimal. (Two different audits of equal cost that lead to one node differ in a letter, never only in length,
so the better prefix stays better whatever follows.)

A conversation of up to ``bound`` rows is searched whole, in a stream over partitions sorted by conversation. A longer one is cut into blocks of
at most ``bound`` rows by its range in the order. Each block is searched from every grammar state to every grammar state; the blocks are then chained by state
in a stream that holds no more than what the surviving chains still disagree on. So a conversation of any length is repaired exactly, and only its small
block summaries, and at last its digest, which is one by definition, go through one task.

Defined cases: null ids are one conversation; null roles and texts are one space. Rows are taken by turn, nulls first, then by
role and a hash of the text. A role's initial is its first character, whatever its case; an empty role has none and cannot be
kept. Extra columns are ignored. Whole texts are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.session import durable, shuffle_width

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FINE, CUT, GONE = 0, 1, 2
START, SYSTEM, USER, ASSISTANT = range(4)
#: The one role that an inserted or changed message can take in each state, and the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
WHOLE = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
NEVER = math.inf

MESSAGES = "array<struct<role:string,text:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def suffix_bounds(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> list[list[float]]:
    """The least cost of the rows from each place on from each state to one of the end states, audits left aside."""

    def inserted(costs: list[float]) -> list[float]:
        # A third insertion in a row would only return to a state already seen.
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    below = inserted([0 if q in ends else NEVER for q in range(4)])
    out = [below]
    for initial, fault in reversed(rows):
        here = [DELETE + c for c in below]
        if fault != GONE:
            extra = TRUNCATED if fault == CUT else 0
            for q in range(4):
                to = KEPT.get((q, initial))
                here[q] = min(here[q], extra + REROLE + below[NEXT[q]], extra + below[to] if to is not None else NEVER)
        below = inserted(here)
        out.append(below)
    return out[::-1]


def search(rows: list[tuple[str, int]], start: int = START, ends: tuple[int, ...] = WHOLE, bounds: list[list[float]] | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the best edits of rows (initial, fault) that lead from a state to an end state."""
    bounds = bounds or suffix_bounds(rows, ends)
    n = len(rows)
    best: tuple[float, str] = (NEVER, "")
    reached: dict[tuple[int, int], tuple[float, str]] = {}
    path: list[str] = []
    stack = [(0, start, 0, 0, "")]
    while stack:
        i, q, cost, depth, letter = stack.pop()
        del path[max(0, depth - 1) :]
        if letter:
            path.append(letter)
        least = cost + bounds[i][q]
        if least > best[0] or least == NEVER:
            continue
        audit = "".join(path)
        if least == best[0] and audit > best[1][:depth]:
            continue
        held = reached.get((i, q))
        if held is not None and held <= (cost, audit):
            continue
        reached[i, q] = cost, audit
        if i == n and q in ends:
            best = min(best, (cost, audit))
        branches = [(5 + cost, "I", i, NEXT[q])]
        if i < n:
            initial, fault = rows[i]
            branches.append((DELETE + cost, "D", i + 1, q))
            if fault != GONE:
                extra = cost + (TRUNCATED if fault == CUT else 0)
                branches.append((REROLE + extra, "R", i + 1, NEXT[q]))
                if (q, initial) in KEPT:
                    branches.append((extra, "K", i + 1, KEPT[q, initial]))
        # The most promising branch is taken first, and so lies on top.
        branches.sort(key=lambda b: (b[0] + bounds[b[2]][b[3]], b[1]), reverse=True)
        stack.extend((j, to, c, depth + 1, x) for c, x, j, to in branches)
    return None if best[0] == NEVER else (int(best[0]), best[1])


def fault(text: str, seen: bool) -> tuple[int, str]:
    """What the search must know of a row, and the name of its first fault."""
    solid = text.rstrip(BLANKS)
    if not solid:
        return GONE, "blank"
    if seen:
        return GONE, "duplicate"
    return (FINE, "") if solid[-1] in ".!?" else (CUT, "truncated")


def messages(rows: list[tuple[str, str]], start: int, audit: str) -> list[dict]:
    """The repaired messages of rows (role, text)."""
    out, q, left = [], start, iter(rows)
    for edit in audit:
        if edit == "I":
            q = NEXT[q]
            out.append({"role": ROLE[q], "text": ""})
            continue
        role, text = next(left)
        if edit == "D":
            continue
        q = NEXT[q] if edit == "R" else KEPT[q, role[:1]]
        out.append({"role": ROLE[q] if edit == "R" else role, "text": text})
    return out


def _judged(turns: list, roles: list[str], faults: list[tuple[int, str]]) -> dict:
    """The counts of consecutive rows of one conversation."""
    names = [name for _, name in faults]
    numbers = [t for t in turns if t is not None]
    return {
        "blank": names.count("blank"), "duplicate": names.count("duplicate"), "truncated": names.count("truncated"),
        "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])), "turns": len(set(numbers)),
        "first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None),
    }


def repair(rows: DataFrame, **options) -> DataFrame:
    """All repaired conversations in segments, see ``repair_parts``."""
    whole, cut = repair_parts(rows, **options)
    return whole.unionByName(cut) if cut is not None else whole


def repair_parts(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bound: int = 1024
) -> tuple[DataFrame, DataFrame | None]:
    """The repaired conversations in segments: conv_id, segment, whole, cost, audit, counts of faults, turns, first and last turn, messages.

    First the conversations of up to ``bound`` rows, each one segment and ``whole``; then, if there are any, the longer ones, of which every
    segment has its own part of cost, audit, counts and messages. ``bound`` is rounded up to a power of two.
    """
    bits = max(1, math.ceil(math.log2(bound)))
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("spread", F.xxhash64("text"))
    kind = dict(plain.dtypes)["conv_id"]
    out = f"conv_id {kind}, segment bigint, whole boolean, cost bigint, audit string, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "first_turn", "last_turn"))
    out += f", messages {MESSAGES}"
    long = plain.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > (1 << bits)).select(F.col("conv_id").alias("long_id"))
    has_long = not long.isEmpty()
    short = plain.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_anti") if has_long else plain
    order = ["conv_id", "turn", "role", "spread"]
    whole = short.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text").mapInArrow(_search_whole(kind), out)
    if not has_long:
        return whole, None
    return whole, _repair_long(plain.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi"), order, bits, kind, out)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def _segment_type(kind: str) -> pa.Schema:
    message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    numbers = [(c, pa.int64()) for c in (*COUNTS, "first_turn", "last_turn")]
    return pa.schema([
        ("conv_id", _arrow(kind)), ("segment", pa.int64()), ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), *numbers, ("messages", message),
    ])


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _runs(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[list[dict]]:
    """Consecutive rows of one key, also across batches."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and any(held[0][k] != row[k] for k in key):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _search_whole(kind: str) -> Callable:
    schema = _segment_type(kind)

    def one(rows: list[dict]) -> dict:
        seen: set[tuple[str, str]] = set()
        faults = []
        for r in rows:
            faults.append(fault(r["text"], (r["role"], r["text"]) in seen))
            seen.add((r["role"], r["text"]))
        cost, audit = search([(r["role"][:1], f) for r, (f, _) in zip(rows, faults)])
        said = messages([(r["role"], r["text"]) for r in rows], START, audit)
        counts = _judged([r["turn"] for r in rows], [r["role"] for r in rows], faults)
        return {"conv_id": rows[0]["conv_id"], "segment": 0, "whole": True, "cost": cost, "audit": audit, **counts, "messages": said}

    return lambda batches: _batches(map(one, _runs(batches, "conv_id")), schema)


def _repair_long(rows: DataFrame, order: list[str], bits: int, kind: str, out: str) -> DataFrame:
    """Segments of conversations longer than a block."""
    laid = rows.withColumn("line", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(rows.sparkSession), *order, "line")
    # Numbers of sorted range partitions rise with the order; so do the blocks cut from them.
    laid = laid.sortWithinPartitions(*order, "line").withColumn("place", F.monotonically_increasing_id())
    laid = durable(laid.select("conv_id", "turn", "role", "text", "place", F.shiftright("place", bits).alias("segment")))
    first = laid.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("place").alias("place"))
    first = first.select("place", F.shiftright("place", bits).alias("segment"))
    numbers = [*COUNTS, "first_turn", "last_turn"]
    option_type = pa.schema([
        ("conv_id", _arrow(kind)), ("segment", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
        *[(c, pa.int64()) for c in numbers], ("first_initial", pa.string()), ("last_initial", pa.string()), ("opens", pa.int64()), ("closes", pa.int64()),
    ])
    option = f"conv_id {kind}, segment bigint, start int, end int, cost bigint, audit string, " + ", ".join(f"{c} bigint" for c in numbers)
    option += ", first_initial string, last_initial string, opens bigint, closes bigint"

    def options(table: pa.Table, firsts: pa.Table) -> pa.Table:
        """Every way through the block for each of its conversations: from each state to each state."""
        found = []
        fresh = set(firsts.column("place").to_pylist())
        for rows in _runs(iter(table.sort_by("place").to_batches()), "conv_id"):
            faults = [fault(r["text"], r["place"] not in fresh) for r in rows]
            plain = [(r["role"][:1], f) for r, (f, _) in zip(rows, faults)]
            counts = _judged([r["turn"] for r in rows], [r["role"] for r in rows], faults)
            edge = {"first_initial": plain[0][0], "last_initial": plain[-1][0], "opens": rows[0]["turn"], "closes": rows[-1]["turn"]}
            for end in range(4):
                bounds = suffix_bounds(plain, (end,))
                for start in range(4):
                    best = search(plain, start, (end,), bounds)
                    if best:
                        found.append({
                            "conv_id": rows[0]["conv_id"], "segment": rows[0]["segment"], "start": start, "end": end, "cost": best[0], "audit": best[1], **counts, **edge,
                        })
        return pa.Table.from_pylist(found, option_type)

    ways = laid.groupBy("segment").cogroup(first.groupBy("segment")).applyInArrow(options, option)
    ways = ways.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "start", "end")
    chosen_type = pa.schema([("conv_id", _arrow(kind)), ("segment", pa.int64()), ("start", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), *[(c, pa.int64()) for c in numbers]])
    chosen = ways.mapInArrow(
        lambda batches: _batches(_chained(batches), chosen_type),
        f"conv_id {kind}, segment bigint, start int, cost bigint, audit string, " + ", ".join(f"{c} bigint" for c in numbers),
    )
    schema = _segment_type(kind)

    def applied(table: pa.Table, choices: pa.Table) -> pa.Table:
        told = {c["conv_id"]: c for c in choices.to_pylist()}
        found = []
        for rows in _runs(iter(table.sort_by("place").to_batches()), "conv_id"):
            c = told[rows[0]["conv_id"]]
            said = messages([(r["role"], r["text"]) for r in rows], c["start"], c["audit"])
            found.append({**{k: c[k] for k in chosen_type.names if k != "start"}, "whole": False, "messages": said})
        return pa.Table.from_pylist(found, schema)

    return laid.groupBy("segment").cogroup(chosen.groupBy("segment")).applyInArrow(applied, out)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The ways through all blocks of a conversation that are best together, block by block.

    ``chains`` holds for each state the best (cost, audit, choices) since the last block all of them agree on; agreed choices
    leave at once.
    """
    chains: dict[int, tuple[int, str, list[dict]]] = {}
    before: dict | None = None
    conv: object = None

    def settled() -> Iterator[dict]:
        ends = [chains[q] for q in WHOLE if q in chains]
        yield from min(ends, key=lambda c: c[:2])[2]

    for ways in _runs(batches, "conv_id", "segment"):
        here = dict(ways[0])
        if before is None or conv != here["conv_id"]:
            if before is not None:
                yield from settled()
            conv, before = here["conv_id"], None
            chains = {START: (0, "", [])}
        else:
            # What lies between two blocks belongs to the later one.
            here["illegal"] += (before["last_initial"] or "") + (here["first_initial"] or "") not in LEGAL
            here["turns"] -= here["opens"] is not None and here["opens"] == before["closes"]
        later: dict[int, tuple[int, str, list[dict]]] = {}
        for way in ways:
            if way["start"] in chains:
                cost, audit, choices = chains[way["start"]]
                total = cost + way["cost"], audit + way["audit"]
                if way["end"] not in later or total < later[way["end"]][:2]:
                    later[way["end"]] = (*total, [*choices, {**here, "start": way["start"], "cost": way["cost"], "audit": way["audit"]}])
        agreed = 0
        lists = [c[2] for c in later.values()]
        while agreed < min(map(len, lists)) and all(x[agreed]["start"] == lists[0][agreed]["start"] and x[agreed]["audit"] == lists[0][agreed]["audit"] for x in lists):
            agreed += 1
        yield from lists[0][:agreed]
        gone = sum(len(c["audit"]) for c in lists[0][:agreed])
        chains = {q: (cost, audit[gone:], choices[agreed:]) for q, (cost, audit, choices) in later.items()}
        before = here
    if before is not None:
        yield from settled()


def report(whole: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit, repaired_sha256 of every conversation that has rows, from its parts."""
    columns = ["conv_id", "gaps", *COUNTS[:4], "cost", "audit", "repaired_sha256"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    whole = whole.withColumn("gaps", gaps).withColumn("repaired_sha256", F.sha2(lines(F.col("messages")), 256)).select(columns)
    if cut is None:
        return whole
    kind = dict(cut.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", _arrow(kind)), *[(c, pa.int64()) for c in columns[1:7]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now: dict | None = None
        for row in _rows(batches, 16):
            if now is None or now["conv_id"] != row["conv_id"]:
                if now is not None:
                    yield _closed(now)
                now = {"conv_id": row["conv_id"], **dict.fromkeys((*COUNTS, "cost"), 0), "low": None, "high": None, "parts": [], "hash": hashlib.sha256(), "any": False}
            for c in (*COUNTS, "cost"):
                now[c] += row[c]
            # Turns rise from segment to segment.
            now["low"] = row["first_turn"] if now["low"] is None else now["low"]
            now["high"] = now["high"] if row["last_turn"] is None else row["last_turn"]
            now["parts"].append(row["audit"])
            if row["line"] is not None:
                now["hash"].update(("\n" if now["any"] else "").encode() + row["line"].encode())
                now["any"] = True
        if now is not None:
            yield _closed(now)

    kept = cut.withColumn("line", F.when(F.size("messages") > 0, lines(F.col("messages")))).drop("messages", "whole")
    streamed = kept.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(
        lambda batches: _batches(digested(batches), schema),
        f"conv_id {kind}, gaps bigint, " + ", ".join(f"{c} bigint" for c in COUNTS[:4]) + ", cost bigint, audit string, repaired_sha256 string",
    )
    return whole.unionByName(streamed)


def _closed(now: dict) -> dict:
    gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
    return {
        "conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in COUNTS[:4]}, "cost": now["cost"], "audit": "".join(now["parts"]),
        "repaired_sha256": now["hash"].hexdigest(),
    }


def lines(said: Column) -> Column:
    """``role:text`` of every message, by lines."""
    return F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def damage(rows: DataFrame) -> DataFrame:
    """A fixed share of the rows dropped, emptied, stripped of their ends of sentences, repeated or given to the user, by a checksum of id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    said = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")
