"""Removal of repeated word windows over the whole corpus (operator 2).

Method: count-min prefilter. Every group of documents writes a count-min sketch of its window hashes, as compressed lists of
touched cells; the shards merge the sketches and answer with one bit per cell: counted at least twice, or not. A sketch
never counts too low, so a window that repeats always passes; only windows that pass in every row go on to the second
pass, which groups them exactly by two 64-bit hashes. A group sends each such window once, with the first of its
documents that has it: a passage found in a third of all rows costs one key per group. The group whose document
comes first keeps its first window, all others are told.

Groups are dealt by a hash of id and text, so that neither one id nor the null ids meet in one group; nothing about groups is known to the plan but
their number.

Defined cases: a null or empty text has no words; a text of fewer words than a window keeps all; the documents of null ids come
first; rows with one id are taken in the order of a hash of their texts. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.llm import exchange as X
from outflow.llm.words import Words, joined, split, window_starts, windows

RESULT_NAMES = ("doc_id", "n_words", "n_removed", "kept_text")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, rows: int = 2, spare: int = 8, carry: tuple[str, ...] = (),
    verbatim: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words outside every window that occurs earlier, joined by one space.

    ``rows`` and ``spare`` size the sketch: rows of cells, and cells per expected window and row. Columns to ``carry`` follow
    as they are, but for those with a name of the result. ``verbatim``: a text that loses nothing stays as it is.
    """
    carry = tuple(c for c in carry if c not in RESULT_NAMES)
    held_columns = {f"carried_{i}": c for i, c in enumerate(carry)}
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(k) for k, c in held_columns.items()]
    )
    size = X.text_bytes(narrow, "text")
    dealt = narrow.withColumn("spread", F.xxhash64("text")).withColumn("grp", X.hash_group(X.group_count(size), "doc_id", "spread"))
    sketch = X.Sketch(size / 6, rows, spare)
    exact_bits = sketch.shard_bits

    def read(table: pa.Table) -> tuple[pa.Table, Words, np.ndarray, np.ndarray]:
        """The group in document order, its words, their hashes, and where its windows start."""
        table = table.sort_by([("doc_id", "ascending"), ("spread", "ascending")]) if table.num_rows > 1 else table
        if table.column("doc_id").null_count:
            null = table.column("doc_id").is_null()
            table = pa.concat_tables([table.filter(null), table.filter(pa.compute.invert(null))])
        words = split(table.column("text"))
        (hashes,) = words.hashes(1)
        return table, words, hashes, np.flatnonzero(window_starts(words.first, window, len(hashes)))

    def sketched(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        _, _, hashes, at = read(table)
        return X.to_table(list(sketch.lists(grp, windows(hashes, window, 3)[at])), X.LIST_NAMES, X.LIST_TYPES)

    def passed(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """By shard: the windows estimated repeated, each once, as sorted pairs of hashes with their first document, and these documents."""
        out = []
        if answers.num_rows:
            table, words, hashes, at = read(table)
            one = windows(hashes, window, 3)[at]
            held = np.ones(len(one), bool)
            for row in range(rows):
                cells = sketch.cells(one, row)
                known = np.unique(cells)
                known = known[sketch.answers(known, row, answers, X.read_bits) > 0]
                held &= np.isin(cells, known)
            one, at = one[held], at[held]
            two = windows(hashes, window, 4)[at]
            # A stable order: the first of equal windows is that of the first document.
            order = np.lexsort((two, one))
            one, two, at = one[order], two[order], at[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            one, two, doc = one[new], two[new], np.searchsorted(words.first, at[new], side="right") - 1
            ids = table.column("doc_id")
            null = ids.is_null().to_numpy().astype(np.uint8)
            ids, spread = ids.fill_null(0).to_numpy(), table.column("spread").to_numpy()
            shards = one >> np.uint64(64 - exact_bits) if exact_bits else np.zeros(len(one), np.uint64)
            for shard in np.unique(shards):
                a, b = np.searchsorted(shards, [shard, shard + np.uint64(1)])
                used, place = np.unique(doc[a:b], return_inverse=True)
                keys = one[a:b].tobytes() + two[a:b].tobytes() + place.astype(np.uint32).tobytes()
                out.append((int(shard), key[0].as_py(), keys, ids[used].tobytes() + spread[used].tobytes() + null[used].tobytes()))
        return X.to_table(out, "shard grp keys docs", [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def settled(table: pa.Table) -> pa.Table:
        """Per group the windows that an earlier document of another group has."""
        groups, ones, twos, places = [], [], [], []
        doc_groups, doc_ids, spreads, nulls, n_docs = [], [], [], [], 0
        for grp, keys, docs in zip(*(table.column(c).to_pylist() for c in ("grp", "keys", "docs"))):
            n, m = len(keys) // 20, len(docs) // 17
            groups.append(np.full(n, grp, np.int32))
            ones.append(np.frombuffer(keys, np.uint64, n))
            twos.append(np.frombuffer(keys, np.uint64, n, 8 * n))
            places.append(np.frombuffer(keys, np.uint32, n, 16 * n) + np.int64(n_docs))
            doc_groups.append(np.full(m, grp, np.int32))
            doc_ids.append(np.frombuffer(docs, np.int64, m))
            spreads.append(np.frombuffer(docs, np.int64, m, 8 * m))
            nulls.append(np.frombuffer(docs, np.uint8, m, 16 * m))
            n_docs += m
        rank = np.empty(n_docs, np.int32)
        rank[np.lexsort((np.concatenate(doc_groups), np.concatenate(spreads), np.concatenate(doc_ids), 1 - np.concatenate(nulls)))] = np.arange(n_docs, dtype=np.int32)
        grp, one, two = map(np.concatenate, (groups, ones, twos))
        order = np.lexsort((rank[np.concatenate(places)], two, one))
        grp, one, two = grp[order], one[order], two[order]
        later = np.zeros(len(one), bool)
        later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        grp, one = grp[later], one[later]
        order = np.argsort(grp, kind="stable")
        grp, one = grp[order], one[order]
        names, begin = np.unique(grp, return_index=True)
        return X.to_table([(int(g), part.tobytes()) for g, part in zip(names, np.split(one, begin[1:]))], "grp earlier", [pa.int32(), pa.binary()])

    def cleaned(table: pa.Table, earlier: pa.Table) -> pa.Table:
        table, words, hashes, at = read(table)
        one, two = windows(hashes, window, 3)[at], windows(hashes, window, 4)[at]
        del hashes
        blobs = [np.frombuffer(b, np.uint64) for b in earlier.column("earlier").to_pylist()]
        gone = np.isin(one, np.concatenate(blobs)) if blobs else np.zeros(len(one), bool)
        order = np.argsort(one, kind="stable")
        again = order[1:][(one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])]
        gone[again] = True
        step = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + window, -1)
        keep = np.cumsum(step)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
        n_words = np.diff(words.first)
        n_removed = n_words - np.diff(kept)
        texts = joined(words, keep).cast(pa.string())
        if verbatim:
            texts = pa.compute.if_else(pa.array(n_removed > 0), texts, pa.concat_arrays(table.column("text").chunks))
        return pa.table({
            "doc_id": table.column("doc_id").combine_chunks(), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept_text": texts, **{k: table.column(k).combine_chunks() for k in held_columns},
        })

    # One placement of the texts serves all three passes.
    lists = dealt.groupBy("grp").applyInArrow(sketched, X.LISTS)
    answers = lists.groupBy("shard").applyInArrow(sketch.merger(lambda n: X.pack_bits(n > 1)), X.ANSWERS)
    keys = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(passed, "shard int, grp int, keys binary, docs binary")
    earlier = keys.groupBy("shard").applyInArrow(settled, "grp int, earlier binary")
    types = dict(narrow.dtypes)
    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string" + "".join(f", {k} {types[k]}" for k in held_columns)
    out = dealt.groupBy("grp").cogroup(earlier.groupBy("grp")).applyInArrow(cleaned, result)
    return out.select(*RESULT_NAMES, *[F.col(k).alias(c) for k, c in held_columns.items()])
