"""Token counts by longest match in linear time (operator 4).

Method: a trie over the vocabulary whose nodes carry a failure link and the number of tokens popped on taking it.
Matching reads each character once: where the trie has no edge, the failure link leads to the node of what is left
after the longest tokens at the front are cut off, and their number is added. No piece is ever built.

The vocabulary marks the pieces that begin a word by a leading U+2581, as the given piece vocabulary does; all others continue one.
Words are runs of characters other than U+0020 and U+0009 to U+000D. A word that cannot be matched to its end counts as one
token (unknown).

Defined cases: null and empty texts have no tokens; rows are counted one by one, repeated or not. Other columns are
passed on unless they clash with a new one. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
KEPT_WORDS = 300_000


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a piece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """Greedy longest-match counting with failure links."""

    def __init__(self, pieces: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.edges[node].get(c)
                if nxt is None:
                    nxt = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = nxt
            final[node] = node > 0
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, pops = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        pops += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], pops
                queue.append(v)

    def count(self, word: str) -> int:
        """Tokens of a word; 1 if it cannot be matched."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for c in MARK + word:
            nxt = edges[node].get(c)
            while nxt is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = edges[node].get(c)
            node = nxt
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


class Counts(dict):
    """Counts of the words met, forgotten together when there are too many."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(Automaton(vocabulary(path)))


def count_tokens(docs: DataFrame, text: str = "text", path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of their text. ``path`` must be readable wherever Spark runs Python."""
    kept = [c for c in docs.columns if c != name and c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts_of(path)
        for batch in batches:
            totals = [sum(map(known.__getitem__, WORD.findall(t.as_py() or ""))) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(totals, pa.int64())], [*kept, name])

    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string"))
    schema = narrow.drop(text).withColumn(name, F.lit(None).cast("bigint")).schema
    for field in schema:
        field.nullable = True
    return narrow.mapInArrow(count, schema)
