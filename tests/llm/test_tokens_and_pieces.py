import random

import numpy as np
import pytest
import sentencepiece

from outflow.llm import pieces, wordpiece
from outflow.llm.pieces import MODEL, Pieces, decode, encode
from outflow.llm.wordpiece import Automaton, count_tokens
from tests.llm import brute

RNG = random.Random(8)
TEXTS = [
    None, "", " ", "a", "  two  spaces ", "Plain words, and more words.\nNext line\ttab", "日本語 ünïcode ﬁ 😀", "▁ marked ▁▁", "x" * 3000, " " * 40,
    "\n\n\r\n", "a\x00b", "ab" * 400 + " " + "é" * 50, "Plain words, and more words.\nNext line\ttab",
]


@pytest.fixture(scope="module")
def vocabulary():
    return wordpiece.vocabulary(MODEL)


def test_counts_match_longest_match(llm, documents, vocabulary):
    known, longest = set(vocabulary), max(map(len, vocabulary))
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(documents(TEXTS)).collect()}
    assert got == {i: sum(brute.longest_match(w, known, longest) for w in brute.WORD.findall(t or "")) for i, t in enumerate(TEXTS)}


def test_counts_on_random_vocabularies():
    for _ in range(300):
        pool = ["▁"] * RNG.randrange(2) + ["".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 6))) for _ in range(RNG.randrange(1, 12))]
        pool += ["▁" + p for p in pool if RNG.random() < 0.4 and p != "▁"]
        automaton = Automaton(pool)
        for _ in range(20):
            word = "".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 14)))
            assert automaton.count(word) == brute.longest_match(word, set(pool), 8), (pool, word)


def test_counts_keep_columns_and_empty_tables(llm):
    rows = llm.createDataFrame([(1, "a b", 5), (1, "a b", 5)], "id int, text string, n_tokens int")
    assert [tuple(r) for r in count_tokens(rows).collect()] == [(1, 2), (1, 2)]
    assert count_tokens(rows.limit(0)).count() == 0


def test_round_trip(documents):
    out = decode(encode(documents(TEXTS))).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_scores_are_the_best_and_stream_in_runs():
    model = pieces.load(MODEL)
    table = {i: s for _, (i, s) in model.scores.items()}
    for text in [t for t in TEXTS if t and "▁" not in t] + ["thinghees onthenou " * 30]:
        chars = " " + text
        whole = [i for run in model.stream(chars) for i in run]
        assert whole == np.frombuffer(model.encode(text), np.int32).tolist()
        if all(i in table for i in whole):
            assert sum(table[i] for i in whole) == pytest.approx(brute.viterbi(chars, model.scores, model.unknown, model.longest))
    assert sum(1 for _ in model.stream(" " + "thinghees onthenou " * 30)) > 5


def test_window_stays_whole_on_random_pieces():
    """Vocabularies without safe boundaries: the streamed path scores as much as the best of all."""
    for _ in range(150):
        own = {c: (i, -RNG.random() * 9) for i, c in enumerate("abc ")}
        for i in range(RNG.randrange(8)):
            own["".join(RNG.choice("abc ") for _ in range(RNG.randrange(2, 5)))] = (10 + i, -RNG.random() * 9)
        model = Pieces(own, list(range(100, 356)))
        text = "".join(RNG.choice("abcd ") for _ in range(RNG.randrange(1, 80)))
        score = {i: s for i, s in model.scores.values()}
        ids = np.frombuffer(model.encode(text), np.int32).tolist()
        total = sum(score.get(i, model.unknown) for i in ids)
        assert total == pytest.approx(brute.viterbi(" " + text, model.scores, model.unknown, model.longest))
        assert model.decode(np.array(ids), np.array([0, len(ids)])).to_pylist() == [text]


def test_library_reads_the_ids(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in [t for t in TEXTS if t and "▁" not in t]:
        assert library.decode(np.frombuffer(pieces.load(MODEL).encode(text), np.int32).tolist()) == text


def test_pieces_keep_columns_and_empty_tables(llm):
    rows = llm.createDataFrame([(1, "a b", 5), (1, "a b", 5)], "id int, text string, ids int")
    out = encode(rows)
    assert out.columns == ["id", "text", "ids"] and out.count() == 2
    assert decode(encode(rows.limit(0))).count() == 0
