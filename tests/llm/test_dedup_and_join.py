import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import outflow.llm.exchange as X
from outflow.llm.ngram_join import link_classes
from outflow.llm.substring_dedup import remove_repeats
from outflow.llm.words import joined, split
from tests.llm import brute

RNG = random.Random(4)
VOCABULARY = ["w%d" % i for i in range(400)] + ["É", "ß.", "日本", "A", "a"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    passage, base = prose(45), prose(120)
    out = [None, "", " \n\t", "one", "one two", "One  TWO", "a\x00b a\x00b", prose(20), prose(19)]
    out += [prose(RNG.randrange(5, 150)) + "\n" + passage + "\x0b" + prose(RNG.randrange(30)) for _ in range(12)]
    out += [base] * 3 + [base.upper()] + [edited(base, RNG.randrange(1, 4)) for _ in range(40)]
    out += [" ".join(["again"] * 90), "again " * 25, prose(6000), "x" * 50_000]
    RNG.shuffle(out)
    return out


def test_words_agree_with_the_pattern(texts):
    found = split(pa.array(texts))
    for i, t in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        assert [found.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b])] == brute.WORD.findall(t or "")
    one, two = found.hashes(1, 2)
    names = [found.data[s:e].tobytes() for s, e in zip(found.starts, found.ends)]
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(set(names))
    keep = np.arange(len(names)) % 3 > 0
    assert joined(found, keep).to_pylist() == [
        " ".join(w for w, k in zip(brute.WORD.findall(t or ""), keep[a:]) if k) for t, a in zip(texts, found.first)
    ]


@pytest.mark.parametrize("group_bytes", [1 << 22, 4000])
def test_repeats_by_brute_force(documents, texts, monkeypatch, group_bytes):
    monkeypatch.setattr(X, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(X, "SHARD_KEYS", 500)
    out = remove_repeats(documents(texts), carry=("source", "kept_text"))
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute.kept_words(list(enumerate(texts)), 20)
    for i, words in enumerate(want):
        assert got[i]["kept_text"] == " ".join(words), i
        assert got[i]["n_words"] - got[i]["n_removed"] == len(words) and got[i]["source"] == "s"


def test_repeats_with_a_narrow_sketch_lose_nothing(documents, texts):
    wide = remove_repeats(documents(texts)).select("doc_id", "kept_text")
    narrow = remove_repeats(documents(texts), rows=1, spare=1).select("doc_id", "kept_text")
    assert wide.exceptAll(narrow).isEmpty()


def test_repeats_edge_rows(llm):
    text = " ".join(map(str, range(30)))
    rows = [(5, text, "x"), (5, text, "y"), (None, text, "z"), (9, text + " end", None), (None, None, None)]
    out = remove_repeats(llm.createDataFrame(rows, "doc_id bigint, text string, grp string"), carry=("grp",)).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in out) == [(0, 0), (30, 0), (30, 30), (30, 30), (31, 30)]
    assert {r["grp"] for r in out if r["n_removed"] == 0} == {"z", None}
    empty = llm.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(empty).count() == 0


def test_verbatim_keeps_untouched_texts(documents):
    text = " ".join(map(str, range(25)))
    out = {r["doc_id"]: r["kept_text"] for r in remove_repeats(documents(["a \n b", text, "c\n" + text + "  d"]), verbatim=True).collect()}
    assert out == {0: "a \n b", 1: text, 2: "c d"}


@pytest.mark.parametrize("width,percent,group_bytes", [(3, 90, 1 << 22), (3, 90, 4000), (5, 80, 4000), (2, 50, 4000)])
def test_links_by_brute_force(documents, texts, monkeypatch, width, percent, group_bytes):
    monkeypatch.setattr(X, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(X, "SHARD_KEYS", 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_classes(documents(texts), width=width, percent=percent).collect()}
    assert got == dict(enumerate(brute.classes(list(enumerate(texts)), width, percent)))


def test_links_hold_over_chains(documents):
    """Each text differs a little from the one before, the first and last a lot."""
    words = prose(100).split(" ")
    texts = []
    for i in range(25):
        words = words.copy()
        words[(37 * i) % 100] = "new%d" % i
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in link_classes(documents(texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute.classes(list(enumerate(texts)), 3, 90))}
    assert set(got.values()) == {0}


def test_links_edge_rows(llm):
    long = prose(50)
    rows = [(7, long, 1), (7, long, 2), (3, long, 3), (None, long, 4), (None, "alone here", 5), (1, None, 6)]
    got = link_classes(llm.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")).collect()
    n = len(brute.shingles(long, 3))
    assert sorted(map(tuple, got), key=repr) == sorted([(7, n, 3), (7, n, 3), (3, n, 3), (None, n, 3), (None, 1, None), (1, 0, 1)], key=repr)
    assert link_classes(llm.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hashed_text_matches_query_digest(documents):
    out = remove_repeats(documents(["a  b"])).select(F.sha2("kept_text", 256).alias("h")).first()
    assert out["h"] == hashlib.sha256(b"a b").hexdigest()
