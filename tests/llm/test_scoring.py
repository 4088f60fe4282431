import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import outflow.llm.exchange as X
from outflow.llm.class_lm import FIRST_WORD, exchange_classes, loosened, score_texts, squeeze
from outflow.llm.cotraining import classify, co_train
from tests.llm import brute

RNG = random.Random(5)
NOUNS, VERBS, RARE = ["cat", "dog", "cow", "pig"], ["eats", "sees", "has", "wants"], ["r%d" % i for i in range(400)]


def sentence(n):
    """Nouns and verbs take turns, so that classes tell more than single words."""
    out = []
    for i in range(n):
        out.append(RNG.choice(RARE) if RNG.random() < 0.1 else RNG.choice(NOUNS if i % 2 else VERBS))
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    return [None, "", "Cat DOG", "never seen words"] + [sentence(RNG.randrange(1, 60)) for _ in range(200)] + [sentence(5000)]


def base_score(texts, ids):
    tokens = {i: [w for w in brute.WORD.findall(brute.lower(texts[i] or ""))] + [None] for i in ids}
    train = Counter(w for i in ids if zlib.crc32(str(i).encode()) % 10 for w in tokens[i])
    n, v = sum(train.values()), len(train)
    return {i: (len(t), sum(w in train for w in t), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens.items()}


@pytest.mark.parametrize("group_bytes", [1 << 22, 3000])
def test_base_score_by_counting(documents, texts, monkeypatch, group_bytes):
    monkeypatch.setattr(X, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(X, "SHARD_KEYS", 30)
    out = {r["doc_id"]: r for r in score_texts(documents(texts), share=0.01).collect()}
    want = base_score(texts, range(len(texts)))
    for i, (n, known, total, score) in want.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)


def test_classes_beat_single_words_on_new_text(documents, texts):
    out = [r for r in score_texts(documents(texts), classes=4, share=0.005).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.9
    assert all(r["score"] < 0 for r in out)


def test_score_does_not_depend_on_the_groups(documents, texts, monkeypatch):
    one = {r["doc_id"]: r["score"] for r in score_texts(documents(texts), classes=4, share=0.005).collect()}
    monkeypatch.setattr(X, "GROUP_BYTES", 2000)
    many = {r["doc_id"]: r["score"] for r in score_texts(documents(texts), classes=4, share=0.005).collect()}
    assert many == pytest.approx(one)


@pytest.mark.parametrize("nouns,verbs", [(4, 4), (5, 3), (9, 5)])
def test_exchange_finds_the_two_kinds(nouns, verbs):
    counts = np.zeros((FIRST_WORD + nouns + verbs,) * 2, np.int64)
    for a in range(nouns):
        for b in range(verbs):
            counts[FIRST_WORD + a, FIRST_WORD + nouns + b] = 20 + RNG.randrange(10)
            counts[FIRST_WORD + nouns + b, FIRST_WORD + a] = 20 + RNG.randrange(10)
    found = exchange_classes(counts, 2, 20)[FIRST_WORD:]
    assert len(set(found[:nouns])) == len(set(found[nouns:])) == 1 and found[0] != found[-1]


def test_exchange_never_lowers_the_likelihood():
    counts = np.random.default_rng(2).integers(0, 9, (FIRST_WORD + 30, FIRST_WORD + 30))

    def likelihood(of):
        one = np.zeros((len(of), of.max() + 1))
        one[np.arange(len(of)), of] = 1
        t = one.T @ counts @ one
        x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return x(t) - x(t.sum(0)) - x(t.sum(1))

    steps = [likelihood(exchange_classes(counts, 5, s)) for s in range(5)]
    assert steps == sorted(steps) and steps[-1] > steps[0]


def test_words_below_the_share_get_classes(documents):
    """Two kinds of words seen a few times each take turns; only a class of their own tells which kind comes next."""
    draw = random.Random(8)
    kinds = [["left%d" % i for i in range(300)] + ["the"] * 40, ["right%d" % i for i in range(300)] + ["goes"] * 40]
    texts = [" ".join(draw.choice(kinds[i % 2]) for i in range(60)) for _ in range(120)]
    held = [r for r in score_texts(documents(texts), classes=2, share=0.02).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    # One of two kinds: log10(2) a token at most.
    assert gain > 0.2


@pytest.mark.parametrize("kind", [np.uint16, np.int32, np.uint32, np.int64])
def test_numbers_are_packed_by_their_bytes(kind):
    rng = np.random.default_rng(3)
    values = (2 ** rng.uniform(0, 6 if kind is np.uint16 else 14, 5000)).astype(kind)
    assert loosened(squeeze(values), kind).tolist() == values.tolist()
    assert len(loosened(squeeze(values[:0]), kind)) == 0
    assert len(squeeze(values)) < 0.95 * len(zlib.compress(values.tobytes(), 1))


def test_language_model_edge_rows(llm):
    rows = [(None, "a b", 1.0), (0, None, 2.0), (0, None, 2.0)]
    out = score_texts(llm.createDataFrame(rows, "doc_id bigint, text string, score double")).collect()
    assert len(out) == 3 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [True]
    assert score_texts(llm.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.fixture(scope="module")
def marked(llm, documents):
    texts = []
    for i in range(500):
        words = [RNG.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(RNG.randrange(5, 80))]
        texts.append(" | ".join(w.upper() + "!!" for w in words) if i % 5 == 0 else " ".join(words) + ".")
    texts[7] = None
    labels = llm.createDataFrame([(i, int(i % 5 > 0), 9) for i in range(0, 500, 3)] + [(11, None, 9), (1000, 0, 9)], "doc_id bigint, quality int, score int")
    return documents(texts), labels


def test_classifier_on_held_out_rows(marked):
    docs, labels = marked
    out = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    assert len(out) == 500
    new = [i for i in range(500) if i % 3 and i != 7]
    assert np.mean([out[i]["keep"] == (i % 5 > 0) for i in new]) > 0.98
    assert all(out[i]["keep"] for i in new if i % 5)


def test_classifier_bounds_and_repeats(marked):
    docs, labels = marked
    again = {r["doc_id"]: r["score"] for r in classify(docs.repartition(5), labels, labelled=60, pool=40).collect()}
    assert again == pytest.approx({r["doc_id"]: r["score"] for r in classify(docs, labels, labelled=60, pool=40).collect()})


def test_views_teach_each_other():
    """The text tells all labels, the metadata only some rows': confident judgements raise what the metadata knows."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 900).astype(float)
    text = y[:, None] * 4 + rng.normal(0, 0.5, (900, 3))
    meta = y[:, None] * 2 + rng.normal(0, 1.0, (900, 12)) + 3 * rng.normal(0, 1, (900, 1))
    known = y.copy()
    known[80:] = np.nan
    together, alone = co_train(text, meta, known, rounds=4), co_train(text, meta, known, rounds=0)
    right = lambda model: np.mean((model.meta.logit(meta[80:]) > 0) == (y[80:] > 0))
    assert right(together) >= right(alone)
    assert np.mean((together.scores(text, meta)[2] > 0.5) == (y > 0)) > 0.98


@pytest.mark.parametrize("labels,score", [([], 1.0), ([(1, 1), (2, 1)], 0.75), ([(1, None)], 1.0)])
def test_classifier_without_two_kinds_of_labels(llm, documents, labels, score):
    out = classify(documents(["a", None, ""]), llm.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert [r["score"] for r in out] == [score] * 3 and all(r["keep"] for r in out)


def test_classifier_edge_rows(llm, marked):
    _, labels = marked
    rows = [(None, None, None, None, None, 7.0), (1, "x" * 20000, "en", "s", 5, 7.0), (1, "y", "en", "s", 5, 7.0)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    out = classify(docs, labels)
    assert out.count() == 3 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_score", "meta_score", "score", "keep"]
    assert classify(docs.limit(0), labels).count() == 0
