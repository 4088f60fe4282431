"""I-Match fingerprints with randomised lexicons, in DataFrame functions only (operator 1).

Method: the lexicon holds the terms whose document frequency lies in a band: not so common that they tell nothing,
not so rare that a small edit changes them. Every subset of the lexicon is a random choice of its terms, by a seeded hash, at one of several rates. A
text's distinct terms of a subset are sorted and hashed; the hashes of all subsets are its fingerprint. The likeness of
two fingerprints is the share of equal hashes among the subsets of which either text has a term, see ``likeness``.

When near copies of one text are a large part of all documents, every term they share is above the band. So the terms above it have levels of subsets
of their own; these count for the likeness of two texts only where one of them has fewer than ``few`` terms in the band.

A term is a lower-case run of characters between white space, known by a 64-bit hash. A text without any term at or above the
band gets the digest of the text itself.

The lexicon is small by construction: a term of it is in at least ``low`` of all documents, so there are at most (distinct terms a
document) / low. It is broadcast only after its number of rows has been found to be at most ``broadcast_terms``; beyond, the join is left to the planner.

For the edited texts documents are dealt into ranges of (id, hash of the text), each with a copy of the row that follows its last one. The bounds
come from a sample; they shape the ranges and no result, and there are at most ``MOST_BLOCKS`` of them in the plan, however large the table.
The rest of the plan keeps that placement: whole texts are shuffled once.

Defined cases: a null text counts as empty; null ids come first; rows with one id are separate documents, in the order of a hash of their texts; of one document the next is itself. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.llm import exchange as X
from outflow.session import durable

SPACE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 4096
#: Sampled rows for each bound between two blocks.
SAMPLED = 20


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), SPACE))


def vocabulary(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """(term, common): hashes of the terms in at least ``low`` of all documents, and in two at least; common are those in more than ``high``."""
    total = docs.count()
    words = docs.select(F.explode(terms(F.col(text))).alias("w")).where("w <> ''").select(F.xxhash64("w").alias("term"))
    seen = words.groupBy("term").agg(F.count("*").alias("df"))
    return durable(seen.where(F.col("df") >= max(2.0, low * total)).select("term", (F.col("df") > max(2.0, high * total)).alias("common")))


def lexicon(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """(term): hashes of the terms in at least ``low`` and at most ``high`` of all documents, and in two at least."""
    return vocabulary(docs, text, low, high).where("NOT common").select("term")


def block_bounds(rows: DataFrame, blocks: int) -> list[tuple[int, int]]:
    """Ascending (uid, spread) that cut the rows into about ``blocks`` ranges, from a sample of fixed size that a hash draws."""
    if blocks < 2:
        return []
    keys = rows.select("uid", "spread")
    part = max(1, keys.count() // (SAMPLED * blocks))
    drawn = sorted(map(tuple, keys.where(F.pmod(F.xxhash64("spread", "uid"), F.lit(part)) == 0).limit(4 * SAMPLED * blocks).collect()))
    return sorted({drawn[len(drawn) * i // blocks] for i in range(1, blocks)}) if drawn else []


def _key(uid: int, spread: int) -> Column:
    return F.struct(F.lit(uid).cast("bigint").alias("uid"), F.lit(spread).cast("bigint").alias("spread"))


def block_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds at or below the row's key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    key = F.struct("uid", "spread")
    at_or_below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    part = at_or_below(F.array(*[_key(*p[0]) for p in parts]))
    table = F.array(F.array(*[_key(*b) for b in parts[0]][:0]).cast("array<struct<uid:bigint,spread:bigint>>"), *[F.array(*[_key(*b) for b in p]) for p in parts])
    return (F.greatest(part - 1, F.lit(0)) * step + at_or_below(F.element_at(table, part + 1))).cast("int")


def level_terms(sorted_terms: Column, rate: int, each: int) -> Column:
    """The terms of a level's subsets. A level deals the lexicon into 2^rate parts; its subsets are the first ``each`` of them."""
    return F.filter(sorted_terms, lambda t: _part(t, rate) < each)


def subset_hashes(of_level: Column, rate: int, each: int) -> Column:
    """The hash of each of a level's subsets, in 32 bits; null where the text has no term of it."""
    parts = [F.filter(of_level, _in_part(rate, i)) for i in range(min(each, 1 << rate))]
    return F.array(*[F.when(F.size(p) > 0, F.shiftrightunsigned(F.xxhash64(p), 32)) for p in parts])


def _part(term: Column, rate: int) -> Column:
    return F.xxhash64(term, F.lit(rate)).bitwiseAND(F.lit((1 << rate) - 1))


def _in_part(rate: int, number: int) -> Callable[[Column], Column]:
    return lambda term: _part(term, rate) == number


def likeness(a: list[Column], b: list[Column], whole_a: Column, whole_b: Column, common: int = 0, scarce: Column | None = None) -> Column:
    """1 for equal fingerprints, else the share of equal hashes among the subsets that either text has a term of.

    The last ``common`` levels count only where ``scarce`` holds.

    Subsets with many of the text's terms nearly always differ after an edit and tell only that there was one. So the
    levels count at which at most three quarters of the subsets are in use, or the sparsest one in use.
    """
    used, equal, last = F.lit(0), F.lit(0), F.lit(0.0)
    for i, (x, y) in enumerate(zip(a, b)):
        marks = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), 0).when(p.eqNullSafe(q), 2).otherwise(1))
        n, same = F.size(F.filter(marks, lambda m: m > 0)), F.size(F.filter(marks, lambda m: m == 2))
        if i >= len(a) - common:
            n, same = F.when(scarce, n).otherwise(0), F.when(scarce, same).otherwise(0)
        sparse = 4 * n <= 3 * F.size(x)
        used, equal = used + F.when(sparse, n).otherwise(0), equal + F.when(sparse, same).otherwise(0)
        last = F.when(n > 0, same / n).otherwise(last)
    return F.when(whole_a == whole_b, 1.0).when(used > 0, equal / used).otherwise(last)


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", low: float = 0.001, high: float = 0.1, rates: tuple[int, ...] = (2, 4, 6, 8, 10),
    each: int = 16, broadcast_terms: int = 500_000, common_rates: tuple[int, ...] = (4, 8), few: int = 8,
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kept = vocabulary(rows, "text", low, high)
    if kept.count() <= broadcast_terms:
        kept = F.broadcast(kept)

    rows = rows.withColumn("uid", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("spread", F.xxhash64("text"))
    blocks = min(MOST_BLOCKS, max(1, X.text_bytes(rows, "text") // BLOCK_BYTES))
    rows = rows.withColumn("block", block_of(block_bounds(rows, blocks)))
    # One row per block comes to the driver: its first key. Empty blocks have none.
    heads = sorted((r.block, tuple(r.head)) for r in rows.groupBy("block").agg(F.min(F.struct("uid", "spread")).alias("head")).collect())
    guest_of: Column = F.lit(None).cast("int")
    if heads:
        last = heads[-1][0] + 1
        first, before = [(0, 0)] * last, [None] * last
        # After the last document comes the first.
        for (block, head), (earlier, _) in zip(heads, [heads[-1], *heads]):
            first[block], before[block] = head, earlier
        place = F.col("block") + 1
        is_head = F.struct("uid", "spread") == F.element_at(F.array(*[_key(*k) for k in first]), place)
        guest_of = F.when(is_head, F.element_at(F.array(*[F.lit(x).cast("int") for x in before]), place))
    copies = F.filter(F.array(F.struct(F.col("block").cast("int").alias("block"), F.lit(0).alias("guest")), F.struct(guest_of.cast("int").alias("block"), F.lit(1).alias("guest"))), lambda c: c["block"].isNotNull())
    dealt = rows.withColumn("copy", F.explode(copies)).select("doc_id", "uid", "spread", "text", "copy.block", "copy.guest")
    line = Window.partitionBy("block").orderBy("guest", "uid", "spread", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    laid = dealt.withColumn("next", F.coalesce(F.lead("text").over(line), F.lit(""))).withColumn("at", F.row_number().over(line))
    laid = laid.select("block", "at", "guest", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    laid = laid.withColumn("text_sha", F.sha2("text", 256)).withColumn("edited_sha256", F.sha2("edited", 256))

    # The document's own columns ride on the first term of each text.
    sides = F.array(F.struct(F.lit(0).alias("side"), terms(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("side"), terms(F.col("edited")).alias("terms")))
    each_side = laid.select("block", "at", "guest", "doc_id", "n_chars", "text_sha", "edited_sha256", F.explode(sides).alias("s"))
    each_term = each_side.select("block", "at", "guest", "doc_id", "n_chars", "text_sha", "edited_sha256", "s.side", F.posexplode("s.terms").alias("pos", "w"))
    first = F.col("pos") == 0
    each_term = each_term.select(
        "block", "at", "side", "pos", F.xxhash64("w").alias("term"),
        *[F.when(first, F.col(c)).alias(c) for c in ("guest", "doc_id", "n_chars", "text_sha", "edited_sha256")],
    )
    held = each_term.join(kept, "term", "left").where(F.col("common").isNotNull() | (F.col("pos") == 0))
    side = lambda i, common: F.sort_array(F.collect_list(F.when((F.col("common") == common) & (F.col("side") == i), F.col("term"))))
    docs_again = held.groupBy("block", "at").agg(
        *[F.max(c).alias(c) for c in ("guest", "doc_id", "n_chars", "text_sha", "edited_sha256")],
        side(0, False).alias("own"), side(1, False).alias("other"), side(0, True).alias("own_common"), side(1, True).alias("other_common"),
    )
    # (column of terms, name of the level, rate): the levels of the band, then those above it.
    levels_of = lambda t: [(t, f"{t}{r}", r) for r in rates] + [(f"{t}_common", f"{t}_common{r}", r) for r in common_rates]
    both = levels_of("own") + levels_of("other")
    levels = docs_again.withColumns({name: level_terms(F.col(t), r, each) for t, name, r in both})
    hashed = levels.withColumns({name: subset_hashes(F.col(name), r, each) for _, name, r in both})
    names = {t: [name for _, name, _ in levels_of(t)] for t in ("own", "other")}
    printed = hashed.withColumn("fingerprint", _printed("own", names["own"], "text_sha")).withColumn("edited_fingerprint", _printed("other", names["other"], "edited_sha256"))
    printed = printed.withColumn("n_own", F.size("own")).withColumn("n_other", F.size("other"))
    following = Window.partitionBy("block").orderBy("at")
    pair = F.lead(F.struct("fingerprint", "n_own", *names["own"])).over(following)
    done = printed.withColumn("next", pair).where("guest = 0")
    own, other, after = ([F.col(c) for c in columns] for columns in (names["own"], names["other"], [f"next.{c}" for c in names["own"]]))
    scarce = lambda n: F.least("n_own", n) < few
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(own, other, F.col("fingerprint"), F.col("edited_fingerprint"), len(common_rates), scarce(F.col("n_other"))).alias("near_edited"),
        F.coalesce(likeness(own, after, F.col("fingerprint"), F.col("next.fingerprint"), len(common_rates), scarce(F.col("next.n_own"))), F.lit(1.0)).alias("near_next"),
    )


def _printed(terms_of: str, levels: list[str], digest: str) -> Column:
    text = F.array_join(F.transform(F.concat(*levels), lambda h: F.lower(F.hex(h))), "-", "")
    return F.when(F.size(terms_of) + F.size(f"{terms_of}_common") > 0, text).otherwise(F.concat(F.lit("t"), F.col(digest)))
