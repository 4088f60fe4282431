"""Perplexity under a class-based bigram model (operator 9).

Method: Brown classes. Every word seen twice or more in training belongs to one of them. The most frequent words are put into
classes by exchange clustering: each word in turn moves to the class that raises the likelihood of the class bigrams most,
until a sweep moves none. With these classes the exchange goes on in batches over all words: each word's neighbours are
counted by class and it moves to the class that fits them best, half of the placed words a round, as long as the likelihood rises.
Words seen once are a class of their own, so are words unseen in training, and the text's end. A word's probability
is P(class | class before) * P(word | class).

For the transitions the words are counted as if the token at hand had not been seen: a word seen once counts
as unseen, one seen twice as seen once. That gives unseen words the share they have in new text.

Counts cover all training documents: groups of documents send their distinct words with counts to the shards that own the key ranges
and get the totals back (see exchange.py); in a round of the exchange they send the words' neighbours by class and get the words' new
classes back. Words are told apart by a 64-bit hash. The driver holds the most frequent words (from ``share`` of the estimated tokens
on) with their bigram table, where the exchange starts, and the bigram table of the classes; neither grows with the input. No word's class
depends on that share: all others are placed in the shards.

Defined cases: a null or empty text is the end token alone; a null id is held out; rows with one id are scored
separately; with no training document every probability is that of an unseen word. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.llm import exchange as X
from outflow.llm.words import mix, split
from outflow.session import durable

RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_log double, score double"
CODED = (
    "grp int, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base_log array<double>,"
    " codes binary, counts binary, places binary, cuts array<int>, frequent array<bigint>, frequent_counts array<bigint>, types bigint, tokens bigint"
)
CODED_TYPES = [
    pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(),
    pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(),
]
CODED_NAMES = " ".join(x.split()[0] for x in CODED.split(", "))
BANDS = 40
# Words seen so often have a class.
PLACED = 2
# Rows of a round's lists that hold the class bigrams as they are, and as if the token at hand had not been seen.
AS_SEEN, AS_UNSEEN = -1, -2
# States: end, unseen, bands (by count; after the exchange only the first, for words seen once), then frequent words or classes.
END, UNSEEN, FIRST_BAND = 0, 1, 2
FIRST_WORD = FIRST_BAND + BANDS


def bands(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = 32, share: float = 1 / 2000, sweeps: int = 20,
    least_gain: float = 1e-3,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), see the query's contract."""
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(True)).alias("held_out"),
    )
    size = X.text_bytes(narrow, "text")
    # Larger groups than elsewhere: a word is sent once a group.
    groups = X.group_count(size // 3)
    dealt = narrow.withColumn("grp", X.hash_group(groups, "doc_id", "text"))
    shard_bits = max(0, math.ceil(math.log2(max(1.0, size / 6 / 8 / X.SHARD_KEYS * 2))))
    frequent_from = max(2.0, size / 6 * share)

    def read(table: pa.Table) -> tuple:
        table = table.sort_by("doc_id")
        words = split(table.column("text"), lower=True)
        (tokens,) = words.hashes(21)
        types, which = np.unique(tokens, return_inverse=True)
        return table, words, types, which, table.column("held_out").to_numpy(zero_copy_only=False)

    def owners(types: np.ndarray) -> np.ndarray:
        """Where each shard's part of the sorted types begins, and the end."""
        if not shard_bits:
            return np.array([0, len(types)])
        return np.concatenate([np.searchsorted(types, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)), [len(types)]])

    def sent(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        table, words, types, which, held = read(table)
        train = np.repeat(~held, np.diff(words.first))
        counts = np.bincount(which[train], minlength=len(types))
        cut = owners(types)
        rows = [
            (s, grp, b - a, types[a:b].tobytes(), b"", squeeze(counts[a:b].astype(np.uint32)))
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a
        ]
        return X.to_table(rows, X.LIST_NAMES, X.LIST_TYPES)

    def totalled(table: pa.Table) -> pa.Table:
        """Each group's answer: its words' totals and their places among the shard's placed words; one row (group -1) about the shard."""
        keys = [np.frombuffer(b, np.uint64) for b in table.column("low").to_pylist()]
        counts = [loosened(b, np.uint32) for b in table.column("counts").to_pylist()]
        types, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(types), np.int64)
        np.add.at(totals, which, np.concatenate(counts).astype(np.int64))
        both = np.stack([totals, np.cumsum(totals >= PLACED) - 1])[:, which]
        answers = [squeeze(part.ravel()) for part in np.split(both, np.cumsum([len(k) for k in keys])[:-1], axis=1)]
        seen = totals[totals > 0]
        about = np.array([len(seen), seen.sum()], np.int64).tobytes()
        shard = table.column("shard")[0].as_py()
        rows = [(g, shard, a) for g, a in zip(table.column("grp").to_pylist(), answers)] + [(-1, shard, about)]
        return X.to_table(rows, "grp shard answer", [pa.int32(), pa.int32(), pa.binary()])

    def coded(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        grp, blobs = key[0].as_py(), answers.column("answer").to_pylist()
        if grp < 0:
            about = np.sum([np.frombuffer(b, np.int64) for b in blobs], axis=0)
            row = (-1, *[None] * 11, int(about[0]), int(about[1]))
            return X.to_table([row], CODED_NAMES, CODED_TYPES)
        table, words, types, which, held = read(table)
        by_shard = dict(zip(answers.column("shard").to_pylist(), blobs))
        parts = [loosened(by_shard[s], np.int64).reshape(2, -1) for s in sorted(by_shard)]
        counts, places = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
        often, placed = counts >= frequent_from, np.flatnonzero(counts >= PLACED)
        cuts = np.searchsorted(placed, owners(types))

        def per_doc(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values[which])])[words.first]
            return np.diff(sums)

        n = np.diff(words.first)
        row = (
            grp, table.column("doc_id").to_pylist(), held.tolist(), (n + 1).tolist(), per_doc((counts > 0).astype(np.int64)).tolist(),
            per_doc(np.log10(counts + 0.1)).tolist(), squeeze(which.astype(np.uint32)), squeeze(counts),
            squeeze(np.diff(places[placed], prepend=0).astype(np.int32)), cuts.tolist(),
            types[often].view(np.int64).tolist(), counts[often].tolist(), None, None,
        )
        return X.to_table([row], CODED_NAMES, CODED_TYPES)

    lists = dealt.groupBy("grp").applyInArrow(sent, X.LISTS)
    answers = lists.groupBy("shard").applyInArrow(totalled, X.ANSWERS)
    corpus = durable(dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(coded, CODED))

    about = corpus.where("grp < 0").first()
    # The end is a token too, seen once in every training document.
    ends = corpus.where("grp >= 0").agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0))).first()[0]
    n_train = (about["tokens"] if about else 0) + ends
    n_types = (about["types"] if about else 0) + (ends > 0)
    # One row per frequent word: fewer than tokens / frequent_from.
    frequent = corpus.where("grp >= 0").select(F.explode(F.arrays_zip("frequent", "frequent_counts")).alias("f")).distinct().toPandas()
    pairs = sorted((int(np.uint64(x[0] & (1 << 64) - 1)), x[1]) for x in frequent["f"]) if len(frequent) else []
    vocabulary = np.array([p[0] for p in pairs], np.uint64)
    states = FIRST_WORD + len(pairs)

    def by_count(counts: np.ndarray, as_unseen: bool) -> np.ndarray:
        """States of words by their counts alone."""
        band = FIRST_BAND + bands(counts) - (as_unseen & (counts & (counts - 1) == 0))
        return np.where((counts > 0) & (band >= FIRST_BAND), band, UNSEEN)

    def expanded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' counts; the token's words, with a place past the last for an end before each document and after the last one;
        where the documents begin; which bigrams are in training."""
        counts = loosened(row["counts"], np.int64)
        n = np.array(row["n_tokens"], np.int64)
        begin = np.cumsum(n) - n
        out = np.full(int(n.sum()) + 1, len(counts), np.int64)
        word_at = np.ones(len(out), bool)
        word_at[begin] = False
        word_at[-1] = False
        out[word_at] = loosened(row["codes"], np.uint32)
        return counts, out, begin, np.repeat(~np.array(row["held_out"], bool), n)

    def frequent_at(row: dict, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the group's frequent words are among its words and in the vocabulary."""
        return np.flatnonzero(counts >= frequent_from), np.searchsorted(vocabulary, np.array(row["frequent"], np.int64).view(np.uint64))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            counts, out, _, train = expanded(row)
            state = np.append(by_count(counts, True), END)
            at, place = frequent_at(row, counts)
            state[at] = FIRST_WORD + place
            out = state[out]
            cell = (out[:-1] * states + out[1:])[train]
            cells = sparse(*np.unique(cell, return_counts=True))
            yield pa.RecordBatch.from_arrays([pa.array([row["grp"]], pa.int32()), pa.array([cells], pa.binary())], ["grp", "cells"])

    def summed(width: int) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            total = np.zeros(width * width, np.int64)
            for blob in table.column("cells").to_pylist():
                cells, counts = dense(blob)
                total[cells] += counts
            cells = np.flatnonzero(total)
            return pa.table({"grp": pa.array([0], pa.int32()), "cells": pa.array([sparse(cells, total[cells])], pa.binary())})

        return merge

    step = max(1, math.isqrt(groups))

    def whole_table(parts: DataFrame, width: int) -> np.ndarray:
        """The groups' bigram tables (grp, cells) added up in two steps."""
        table = parts.withColumn("part", F.col("grp") % step).groupBy("part").applyInArrow(summed(width), "grp int, cells binary")
        table = table.groupBy("grp").applyInArrow(summed(width), "grp int, cells binary").first()
        seen = np.zeros(width * width, np.int64)
        if table:
            cells, counts = dense(table["cells"])
            seen[cells] = counts
        return seen.reshape(width, width)

    documents = corpus.where("grp >= 0")
    parts = documents.select("grp", "held_out", "n_tokens", "codes", "counts", "frequent").mapInArrow(bigrams, "grp int, cells binary")
    start = exchange_classes(whole_table(parts, states), classes, sweeps)[FIRST_WORD:].astype(np.uint16)
    width = FIRST_WORD + classes

    def first_classes(row: dict, counts: np.ndarray) -> np.ndarray:
        """The states of the group's placed words before the first round: of frequent ones their class, of others their band."""
        first = by_count(counts, False).astype(np.uint16)
        if len(start) < classes:
            # Too few frequent words to tell classes apart: the others are dealt round.
            places = np.cumsum(loosened(row["places"], np.int32), dtype=np.int64)
            first[counts >= PLACED] = FIRST_WORD + places % classes
        at, place = frequent_at(row, counts)
        first[at] = start[place]
        return first[counts >= PLACED]

    def neighbours(row: dict, placed: np.ndarray | None) -> pa.Table:
        """For each shard the group's placed words, their classes and how often a class stands after or before each; the class bigrams."""
        counts, out, _, train = expanded(row)
        placed = first_classes(row, counts) if placed is None else placed
        is_placed = counts >= PLACED
        state, unseen = np.append(by_count(counts, False), END), np.append(by_count(counts, True), END)
        state[:-1][is_placed] = placed
        unseen[:-1][counts > PLACED] = state[:-1][counts > PLACED]
        number = np.full(len(counts) + 1, -1, np.int64)
        number[:-1][is_placed] = np.arange(int(is_placed.sum()))
        before, after = out[:-1][train], out[1:][train]
        cells = np.concatenate([(number[before] * 2) * width + state[after], (number[after] * 2 + 1) * width + state[before]])
        cells, n = np.unique(cells[np.concatenate([number[before], number[after]]) >= 0], return_counts=True)
        places = np.cumsum(loosened(row["places"], np.int32), dtype=np.int64)
        rows = []
        for shard, (a, b) in enumerate(zip(row["cuts"][:-1], row["cuts"][1:])):
            if b > a:
                own = slice(*np.searchsorted(cells, [a * 2 * width, b * 2 * width]))
                # At least one word of a shard begins its places anew.
                low = squeeze(np.diff(places[a:b], prepend=0).astype(np.int32))
                high = squeeze(placed[a:b])
                gaps = np.diff(cells[own] - a * 2 * width, prepend=0)
                rows.append((shard, row["grp"], b - a, low, high, squeeze(np.concatenate([gaps, n[own]]).astype(np.uint32))))
        for kind, of in ((AS_SEEN, state), (AS_UNSEEN, unseen)):
            rows.append((kind, row["grp"], 0, sparse(*np.unique(of[before] * width + of[after], return_counts=True)), b"", b""))
        return X.to_table(rows, X.LIST_NAMES, X.LIST_TYPES)

    def first_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from neighbours(row, None).to_batches()

    def told(answers: pa.Table) -> np.ndarray:
        """The classes of a group's placed words, from the shards' answers."""
        found = sorted(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist()))
        return np.concatenate([np.zeros(0, np.uint16)] + [loosened(a, np.uint16) for _, a in found])

    def next_lists(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return neighbours(table.to_pylist()[0], told(answers))

    def mover(table: np.ndarray, turn: int) -> Callable[[pa.Table], pa.Table]:
        def moved(lists: pa.Table) -> pa.Table:
            """Each group's words with their new classes."""
            shard = lists.column("shard")[0].as_py()
            places = [np.cumsum(loosened(b, np.int32), dtype=np.int64) for b in lists.column("low").to_pylist()]
            old = np.zeros(max(int(p[-1]) for p in places) + 1, np.int64)
            cells, counts = [], []
            for p, high, blob in zip(places, lists.column("high").to_pylist(), lists.column("counts").to_pylist()):
                old[p] = loosened(high, np.uint16)
                gaps, n = loosened(blob, np.uint32).astype(np.int64).reshape(2, -1)
                cell = np.cumsum(gaps)
                cells.append(p[cell // (2 * width)] * 2 * width + cell % (2 * width))
                counts.append(n)
            cells, which = np.unique(np.concatenate(cells), return_inverse=True)
            n = np.zeros(len(cells), np.int64)
            np.add.at(n, which, np.concatenate(counts))
            new = better_classes(table, old, cells, n)
            # Words of the same neighbours would change places together for ever; half of them wait.
            waits = (old >= FIRST_WORD) & ((mix(np.arange(len(old), dtype=np.uint64)) >> np.uint64(40)).astype(np.int64) + turn & 1 == 1)
            new = np.where(waits, old, new).astype(np.uint16)
            rows = [(g, shard, squeeze(new[p])) for g, p in zip(lists.column("grp").to_pylist(), places)]
            return X.to_table(rows, "grp shard answer", [pa.int32(), pa.int32(), pa.binary()])

        return moved

    narrow = documents.select("grp", "held_out", "n_tokens", "codes", "counts", "places", "cuts", "frequent")
    lists = durable(narrow.mapInArrow(first_lists, X.LISTS))
    turn, best, kept, seen, unseen = 0, None, None, None, None
    placed = None
    while True:
        table_of = lambda kind: whole_table(lists.where(F.col("shard") == kind).select("grp", F.col("low").alias("cells")), width)
        table = table_of(AS_SEEN)
        value = likelihood(table)
        # The first table has words in bands, which the next has not.
        if turn < 2 or value > best:
            raised, best, kept, seen, unseen = turn < 2 or value - best > least_gain * abs(best), value, placed, table, table_of(AS_UNSEEN)
        else:
            raised = False
        # Both halves have had their turn after two rounds.
        if turn > 2 and not raised or not table.any():
            break
        placed = durable(lists.where("shard >= 0").groupBy("shard").applyInArrow(mover(table, turn), X.ANSWERS))
        lists = durable(narrow.groupBy("grp").cogroup(placed.groupBy("grp")).applyInArrow(next_lists, X.LISTS))
        turn += 1
    transition, mass = model(unseen), np.maximum(seen.sum(0), 1)

    def score(row: dict, placed: np.ndarray) -> pa.RecordBatch:
        counts, out, begin, _ = expanded(row)
        state = np.append(by_count(counts, False), END)
        state[:-1][counts >= PLACED] = placed
        # Words unseen are one type.
        emission = np.append(np.where(counts > 0, np.log10(np.maximum(counts, 1) / mass[state[:-1]]), 0.0), 0.0)
        of = state[out]
        total = np.add.reduceat(transition[of[:-1], of[1:]] + emission[out[1:]], begin)
        return pa.RecordBatch.from_arrays([
            pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"]), pa.array(row["n_tokens"], pa.int64()),
            pa.array(row["n_known"], pa.int64()), pa.array(row["base_log"], pa.float64()), pa.array(total),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "base_log", "score"])

    def scored(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([score(row, told(answers)) for row in table.to_pylist()])

    if kept is None:
        # No training token.
        kept = documents.select("grp", F.lit(0).alias("shard"), F.lit(squeeze(np.zeros(0, np.uint16))).alias("answer"))
    out = documents.groupBy("grp").cogroup(kept.groupBy("grp")).applyInArrow(scored, RESULT)
    below = math.log10(n_train + 0.1 * (n_types + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base_log") + math.log10(ends + 0.1) - F.col("n_tokens") * below).alias("base_score"), "score",
    )


def squeeze(values: np.ndarray) -> bytes:
    """The values, compressed with all first bytes before all second ones and so on: the high bytes are mostly zero."""
    return zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def loosened(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def sparse(cells: np.ndarray, counts: np.ndarray) -> bytes:
    return squeeze(np.concatenate([np.diff(cells, prepend=0), counts]).astype(np.int64))


def dense(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = loosened(blob, np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    x = table.astype(np.float64)
    return float(_xlogx(x).sum() - _xlogx(x.sum(0)).sum() - _xlogx(x.sum(1)).sum())


def better_classes(table: np.ndarray, old: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most while all others stay.

    ``cells`` are sorted: twice the word's number, plus one where the class stands before it, times the states, plus the state.
    """
    width = len(table)
    table = table.astype(np.float64)
    choices = width - FIRST_WORD
    gain = np.zeros((len(old), choices))
    word, side, state = cells // (2 * width), cells // width % 2, cells % width
    for a in range(0, len(cells), 1 << 16):
        w, n = word[a : a + (1 << 16)], counts[a : a + (1 << 16)].astype(np.float64)
        s, before = state[a : a + (1 << 16)], side[a : a + (1 << 16)] == 1
        base = np.where(before[:, None], table[s, FIRST_WORD:], table[FIRST_WORD:, s].T)
        own = np.flatnonzero(old[w] >= FIRST_WORD)
        # The table without the word.
        base[own, old[w[own]] - FIRST_WORD] -= n[own]
        base = np.maximum(base, 0)
        more = _xlogx(base + n[:, None]) - _xlogx(base)
        heads = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[heads]] += np.add.reduceat(more, heads)
    placed = np.flatnonzero(old >= FIRST_WORD)
    for before, sums in ((0, table.sum(1)), (1, table.sum(0))):
        of = side == before
        n = np.bincount(word[of], weights=counts[of], minlength=len(old))
        # A slice at a time, as the sums of all words by class would be as wide as the gains again.
        for a in range(0, len(old), 1 << 16):
            part = np.arange(a, min(len(old), a + (1 << 16)))
            base = np.repeat(sums[None, FIRST_WORD:], len(part), axis=0)
            own = np.flatnonzero(old[part] >= FIRST_WORD)
            base[own, old[part[own]] - FIRST_WORD] -= n[part[own]]
            base = np.maximum(base, 0)
            gain[part] -= _xlogx(base + n[part, None]) - _xlogx(base)
    best = gain.argmax(1)
    stays = placed[gain[placed, best[placed]] <= gain[placed, old[placed] - FIRST_WORD] + 1e-9]
    new = FIRST_WORD + best
    new[stays] = old[stays]
    return new


def exchange_classes(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of every state. States that are not words keep classes of their own: 0 to FIRST_WORD - 1."""
    states = len(counts)
    counts = counts.astype(np.float64)
    words = np.arange(FIRST_WORD, states)
    total = FIRST_WORD + classes
    class_of = np.arange(states)
    if not len(words):
        return class_of
    # Start from the order of frequency, dealt round.
    order = words[np.argsort(-(counts[words].sum(1)), kind="stable")]
    class_of[order] = FIRST_WORD + np.arange(len(order)) % classes
    one = np.zeros((states, total))
    one[np.arange(states), class_of] = 1
    table = one.T @ counts @ one
    to_class, from_class = counts @ one, one.T @ counts
    choices = np.arange(FIRST_WORD, total)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            old = class_of[w]
            row, column, loop = to_class[w].copy(), from_class[:, w].copy(), counts[w, w]
            row[old] -= loop
            column[old] -= loop
            # The table without the word.
            table[old] -= row
            table[:, old] -= column
            table[old, old] -= loop
            sub, add_row, add_column = table[choices], row[None, :], column[None, :]
            cols = table[:, choices].T
            own = table[choices, choices]
            at = np.arange(len(choices))
            gain_row = _xlogx(sub + add_row) - _xlogx(sub)
            gain_column = _xlogx(cols + add_column) - _xlogx(cols)
            gain = gain_row.sum(1) + gain_column.sum(1) - gain_row[at, choices] - gain_column[at, choices]
            gain += _xlogx(own + row[choices] + column[choices] + loop) - _xlogx(own)
            # The word's neighbours stay in their classes' sums wherever it goes.
            out_sum, in_sum = sub.sum(1) + column[choices], cols.sum(1) + row[choices]
            gain -= _xlogx(out_sum + row.sum() + loop) - _xlogx(out_sum) + _xlogx(in_sum + column.sum() + loop) - _xlogx(in_sum)
            best = int(choices[np.argmax(gain)])
            if gain[best - FIRST_WORD] <= gain[old - FIRST_WORD] + 1e-9:
                best = int(old)
            table[best] += row
            table[:, best] += column
            table[best, best] += loop
            if best != old:
                moved += 1
                class_of[w] = best
                to_class[:, old] -= counts[:, w]
                to_class[:, best] += counts[:, w]
                from_class[old] -= counts[w]
                from_class[best] += counts[w]
        if not moved:
            break
    return class_of


def model(table: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """log10 P(class | class)."""
    # After the exchange no word is in a band but the first.
    used = np.ones(len(table))
    used[FIRST_BAND + 1 : FIRST_WORD] = 0
    share = (table.sum(0) + 0.5 * used) / (table.sum() + 0.5 * used.sum())
    return np.log10(np.maximum((table + prior * share[None, :]) / (table.sum(1, keepdims=True) + prior), 1e-300))
