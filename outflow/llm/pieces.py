"""Encoding texts as piece ids by streaming Viterbi, and decoding them (operator 5).

Method: the segmentation with the highest sum of piece scores, found from left to right. Only a window of positions
is kept: those not longer ago than the longest piece can begin a later piece, and their back pointers. Whenever
the paths of all of them run through one boundary, the ids before it are final and leave the window.

Texts follow the piece model's form: a space before the text, spaces as U+2581; a character that no piece holds, and a
U+2581 in the text itself, becomes its UTF-8 bytes, at the score of an unknown character. Decoding is the exact inverse.

Where no piece can span a boundary (before the spaces that follow a word, around characters that occur in no longer
piece), all paths meet by construction, so the ids of the stretch between two such boundaries depend on it alone and are remembered.

Defined cases: null and empty texts have no ids and are decoded as empty; of equal scores the longer last piece wins. Other
columns are passed on unless they clash with a new one. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEPT_STRETCHES = 600_000
#: Below the lowest score of a piece.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces with scores, ids of single bytes, and the places no piece spans."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.scores = {p.replace(MARK, " "): s for p, s in pieces.items()}
        self.byte_ids = byte_ids
        # Pieces, and None for what only begins one.
        self.trie: dict[str, tuple[int, float] | None] = {p[:i]: None for p in self.scores for i in range(1, len(p))}
        self.trie.update(self.scores)
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min((s for _, s in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        long = [p for p in self.scores if len(p) > 1]
        inner = {c for p in long for c in p}
        apart = [c for c in "\n\t\r\x0b\x0c" if c not in inner]
        alone = re.escape("".join(apart))
        if any(re.search("[^ ] ", p) for p in long):
            self.stretch = re.compile(".+", re.S)
        else:
            self.stretch = re.compile(f" *[^ {alone}]+|[{alone}]| +" if alone else " *[^ ]+| +")
        self.known: dict[str, bytes] = {}
        n = max([i for i, _ in self.scores.values()] + byte_ids, default=-1) + 1
        table: list[bytes] = [b""] * n
        for piece, (i, _) in self.scores.items():
            table[i] = piece.encode()
        for value, i in enumerate(byte_ids):
            table[i] = bytes([value])
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(table), np.uint8)

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Ids of a text in the model's form, in runs, each as soon as it is final."""
        scores, longest = self.scores, self.longest
        # Window: positions base.. with the best score, where the last piece began and its ids.
        base, best, back, ids = 0, [0.0], [0], [[]]
        for end in range(1, len(chars) + 1):
            top, begin, own = None, end - 1, None
            for start in range(max(base, end - longest), end):
                found = scores.get(chars[start:end])
                if found is not None and (top is None or best[start - base] + found[1] > top):
                    top, begin, own = best[start - base] + found[1], start, [found[0]]
            # A single character can always be taken, as bytes.
            if own is None or (begin < end - 1 and chars[end - 1] not in scores and best[end - 1 - base] + self.unknown > top):
                top, begin = best[end - 1 - base] + self.unknown, end - 1
                own = [self.byte_ids[b] for b in chars[end - 1].encode()]
            best.append(top)
            back.append(begin)
            ids.append(own)
            if end - base >= 2 * longest:
                # Follow the last position of the live ones back until they are one.
                live = set(range(end - longest + 1, end + 1))
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back[last - base])
                (meet,) = live
                if meet > base:
                    yield self._path(base, meet, back, ids)
                    cut = meet - base
                    base, best, back, ids = meet, best[cut:], back[cut:], ids[cut:]
                    back[0] = base
        yield self._path(base, len(chars), back, ids)

    def short(self, chars: str) -> list[int]:
        """The same for a stretch that fits into the window: nothing is final before its end."""
        trie, n, unknown = self.trie, len(chars), self.unknown
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            before = best[start]
            end = start + 1
            found = trie.get(chars[start], 0)
            if not found and before + unknown > best[end]:
                best[end], back[end], piece[end] = before + unknown, start, -1
            # Longer and longer, as long as a piece begins so.
            while found != 0:
                if found is not None and before + found[1] > best[end]:
                    best[end], back[end], piece[end] = before + found[1], start, found[0]
                end += 1
                if end > n:
                    break
                found = trie.get(chars[start:end], 0)
        out = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(chars[n - 1].encode()))
            n = back[n]
        out.reverse()
        return out

    @staticmethod
    def _path(base: int, end: int, back: list[int], ids: list[list[int]]) -> list[int]:
        runs = []
        while end > base:
            runs.append(ids[end - base])
            end = back[end - base]
        return [i for run in reversed(runs) for i in run]

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers. U+2581 is in no table entry, as entries hold spaces, so it falls to bytes."""
        if not text:
            return b""
        known = self.known
        out = []
        for s in self.stretch.findall(" " + text):
            ids = known.get(s)
            if ids is None:
                if len(known) >= KEPT_STRETCHES:
                    known.clear()
                found = self.short(s) if len(s) < 2 * self.longest else [i for run in self.stream(s) for i in run]
                ids = known[s] = array("i", found).tobytes()
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of consecutive runs of ids."""
        lens = self.lengths[ids]
        ahead = np.concatenate([[0], np.cumsum(lens)])
        place = np.arange(int(ahead[-1])) - np.repeat(ahead[:-1], lens)
        data = self.letters[np.repeat(self.begins[ids], lens) + place]
        at = ahead[offsets]
        # Without the space set before the text.
        return pa.array([data[a + 1 : b].tobytes().decode("utf-8", "replace") if b > a else "" for a, b in zip(at[:-1], at[1:])], pa.string())


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return Pieces(plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


SLICE = 512


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, name: str = "ids", decoded: str | None = None) -> DataFrame:
    """The rows with the ids of their text, which is kept. ``path`` must be readable wherever Spark runs Python.

    ``decoded`` names a further column for the text that the ids give back, found in the same pass.
    """
    columns = [c for c in docs.columns if c not in (name, decoded)]
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                coded = [pieces.encode(t.as_py() or "") for t in batch.column(at)]
                offsets = np.cumsum([0, *(len(b) // 4 for b in coded)]).astype(np.int32)
                ids = np.frombuffer(b"".join(coded), np.int32)
                out = {name: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}
                if decoded:
                    out[decoded] = pieces.decode(ids.astype(np.int64), offsets)
                yield pa.RecordBatch.from_arrays([*batch.columns, *out.values()], [*columns, *out])

    kinds = {name: "array<int>"} | ({decoded: "string"} if decoded else {})
    return _mapped(docs.select(*[F.col(f"`{c}`") for c in columns]), run, kinds)


def decode(rows: DataFrame, ids: str = "ids", path: str = MODEL, name: str = "decoded") -> DataFrame:
    """The rows with the text of their ids."""
    columns = [c for c in rows.columns if c != name]
    at = columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                lists = batch.column(at)
                lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(lens)])
                texts = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*columns, name])

    return _mapped(rows.select(*[F.col(f"`{c}`") for c in columns]), run, {name: "string"})


def _mapped(rows: DataFrame, run, kinds: dict[str, str]) -> DataFrame:
    schema = rows.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()}).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(run, schema)
