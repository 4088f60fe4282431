"""Document quality by co-training two views (operator 3).

Method: one classifier reads the text, one the page's metadata (language, source, length). Each is fitted on labelled
documents; then, round by round, each gives the other its most confident judgements on unlabelled documents as further labels. At the end
each view is calibrated, and the calibrated views are combined, on labelled documents kept out of the fitting. The combined score
is computed for every document.

Both views are logistic regressions. The text's features are the shares of words by hash bucket, the shares of single
characters and kinds of characters, word length and immediate repetition; of the metadata language and source by hash bucket and
the logarithm of the length.

Fitting takes at most ``labelled`` labelled and ``pool`` unlabelled documents, chosen by the hash of their ids; both
bounds are parameters. Their features (about two kilobytes a document) meet in one task, and the model comes to the driver.

Defined cases: null text counts as empty, null language, source and length are values of their own; labels of null are left out, of several labels of a
document the lowest counts; with no label every score is 1, with labels of one kind only it is their smoothed share; rows with one id are
scored separately. The input's columns are kept, but those named as a new one are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.llm.words import split

NEW = {"text_score": "double", "meta_score": "double", "score": "double", "keep": "boolean"}
WORD_BUCKETS = 512
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16
SLICE = 256

# Kinds of characters: the printable ASCII punctuation one by one, then digits, capitals, small letters, white space, others.
KIND = np.full(256, 36, np.int64)
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
KIND[_MARKS] = np.arange(len(_MARKS))
KIND[48:58], KIND[65:91], KIND[97:123] = 32, 33, 34
KIND[[32, 9, 10, 11, 12, 13]] = 35
KINDS = 37


def text_features(texts: pa.Array) -> np.ndarray:
    words = split(texts)
    n_docs = len(texts)
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(n_docs), counts)
    per_doc = lambda values: np.bincount(owner, weights=values, minlength=n_docs)
    many = np.maximum(counts, 1)
    (hashes,) = words.hashes(31)
    bag = np.bincount(owner * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n_docs * WORD_BUCKETS)
    lens = words.ends - words.starts
    again = np.zeros(len(hashes))
    for back in (1, 2, 3):
        same = np.zeros(len(hashes), bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        again = np.maximum(again, same)
    # The characters of words only: white space at the edges tells little.
    chars = words.data[np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(words.starts, lens)]
    kinds = np.bincount(np.repeat(owner, lens) * KINDS + KIND[chars], minlength=n_docs * KINDS).reshape(n_docs, KINDS)
    extra = np.stack([per_doc(lens) / many, per_doc(again) / many, np.log1p(counts), counts == 0], 1)
    return np.concatenate([np.sqrt(bag.reshape(n_docs, WORD_BUCKETS) / many[:, None]), np.sqrt(kinds / np.maximum(kinds.sum(1), 1)[:, None]), extra], 1)


def meta_features(langs: list, sources: list, chars: list) -> np.ndarray:
    out = np.zeros((len(langs), LANG_BUCKETS + SOURCE_BUCKETS + 3))
    for i, (lang, source, n) in enumerate(zip(langs, sources, chars)):
        out[i, zlib.crc32(repr(lang).encode()) % LANG_BUCKETS] = 1
        out[i, LANG_BUCKETS + zlib.crc32(repr(source).encode()) % SOURCE_BUCKETS] = 1
        size = np.log1p(max(n, 0)) if n is not None else 0.0
        out[i, -3:] = size, size * size / 10, n is None
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features, with a ridge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> Logistic:
        mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = ((x - mean) / scale).astype(np.float32)
        share = (y.sum() + 1) / (len(y) + 2)
        w, b, vw, vb = np.zeros(z.shape[1]), float(np.log(share / (1 - share))), 0.0, 0.0
        # Nesterov's gradient method; the step is the inverse of a bound of the curvature.
        u = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), np.float32)
        for _ in range(12):
            u = z.T @ (z @ u)
            u /= max(np.linalg.norm(u), 1e-12)
        top = max(float(np.linalg.norm(z @ u) ** 2 / len(z)), 1.0)
        rate = 1.0 / (0.25 * (top + 1) + ridge)
        for _ in range(steps):
            aw, ab = w + 0.9 * vw, b + 0.9 * vb
            error = 1 / (1 + np.exp(-np.clip(z @ aw.astype(np.float32) + ab, -30, 30))) - y
            nw, nb = aw - rate * (z.T @ error.astype(np.float32) / len(z) + ridge * aw), ab - rate * error.mean()
            vw, vb, w, b = nw - w, nb - b, nw, nb
        return cls(mean, scale, w, b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class CoTrained:
    """Both views, their calibration (slope, offset) and the weights of the combination."""

    text: Logistic | None
    meta: Logistic | None
    calibration: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray
    constant: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            return (np.full(len(text), self.constant),) * 3
        a = self.calibration[0][0] * self.text.logit(text) + self.calibration[0][1]
        b = self.calibration[1][0] * self.meta.logit(meta) + self.calibration[1][1]
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression of a few columns, the last a constant, drawn towards the start."""
    w = start.astype(float).copy()
    for _ in range(25):
        p = sigmoid(np.clip(x @ w, -30, 30))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * (w - start))
    return w


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 3, sure: float = 0.97, growth: float = 0.1) -> CoTrained:
    """Fit on rows in a random order; y is NaN where there is no label. Every fourth labelled row is kept for calibration."""
    labelled = np.flatnonzero(~np.isnan(y))
    good = y[labelled]
    none = (np.array([1.0, 0.0]),) * 2
    if not len(labelled):
        return CoTrained(None, None, none, np.array([1.0, 0.0, 0.0]), 1.0)
    kept = labelled[3::4] if len(labelled) >= 40 else labelled
    own = np.setdiff1d(labelled, kept) if len(labelled) >= 40 else labelled
    if good.min() == good.max() or y[own].min() == y[own].max():
        return CoTrained(None, None, none, np.array([1.0, 0.0, 0.0]), float((good.sum() + 1) / (len(good) + 2)))
    pool = np.flatnonzero(np.isnan(y))
    # What each view has learned from: row and label.
    rows, marks, views = [own, own], [y[own], y[own]], [text, meta]
    for _ in range(rounds):
        models = [Logistic.fit(v[r], m) for v, r, m in zip(views, rows, marks)]
        if not len(pool):
            break
        taken = np.zeros(len(pool), bool)
        for i in (0, 1):
            p = sigmoid(models[i].logit(views[i][pool]))
            most = max(1, int(growth * len(pool)))
            for label, confidence in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-confidence, kind="stable")[:most]
                best = best[(confidence[best] >= sure) & ~taken[best]]
                taken[best] = True
                rows[1 - i] = np.concatenate([rows[1 - i], pool[best]])
                marks[1 - i] = np.concatenate([marks[1 - i], np.full(len(best), label)])
        pool = pool[~taken]
    models = [Logistic.fit(v[r], m) for v, r, m in zip(views, rows, marks)]
    logits = [m.logit(v[kept]) for m, v in zip(models, views)]
    calibration = tuple(_newton(np.stack([z, np.ones(len(z))], 1), y[kept], np.array([1.0, 0.0]), 1.0) for z in logits)
    both = np.stack([*(c[0] * z + c[1] for c, z in zip(calibration, logits)), np.ones(len(kept))], 1)
    # A view without information is calibrated to the mean; its weight starts from nothing.
    weights = _newton(both, y[kept], np.array([1.0, 0.0, 0.0]), 1.0)
    return CoTrained(models[0], models[1], calibration, weights, float(good.mean()))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, source: str, n_chars: str, label: str, labelled: int, pool: int, rounds: int
) -> CoTrained:
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("double").alias("y")).where("id IS NOT NULL")
    ids = docs.select(F.col(doc_id).alias("id")).where("id IS NOT NULL").distinct()
    turn = F.xxhash64("id")
    known = ids.join(marks, "id").orderBy(turn, "id").limit(labelled)
    unknown = ids.join(marks, "id", "left_anti").orderBy(turn, "id").limit(pool).withColumn("y", F.lit(None).cast("double"))
    # At most labelled + pool rows.
    chosen = known.select("id", "y").union(unknown.select("id", "y"))
    narrow = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"), F.col(n_chars).cast("double").alias("n_chars"),
    )
    sample = narrow.join(F.broadcast(chosen), "id").dropDuplicates(["id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                x = text_features(b.column("text")).astype(np.float32)
                m = meta_features(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("turn"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())],
                    ["turn", "y", "x", "m"],
                )

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn")
        y = table.column("y").cast(pa.float64()).fill_null(np.nan).to_numpy()
        x, m = (np.stack([np.frombuffer(b.as_py(), np.float32) for b in table.column(c)]) for c in ("x", "m"))
        return pa.table({"model": pa.array([pickle.dumps(co_train(x, m, y, rounds))], pa.binary())})

    rows = sample.withColumn("turn", F.xxhash64(F.lit(1), "id")).mapInArrow(features, "turn bigint, y double, x binary, m binary")
    # One group of at most labelled + pool rows; the driver gets the model.
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "model binary").first()
    return pickle.loads(found["model"]) if found else co_train(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0), rounds)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    n_chars: str = "n_chars", label: str = "quality", labelled: int = 6000, pool: int = 4000, rounds: int = 3, least: float = 0.5,
) -> DataFrame:
    """The documents with text_score, meta_score, score (of being good) and keep (score at least ``least``)."""
    model = fit(docs, labels, doc_id, text, lang, source, n_chars, label, labelled, pool, rounds)
    kept = [c for c in docs.columns if c not in NEW]
    at = {c: kept.index(c) for c in (text, lang, source, n_chars)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                meta = meta_features(
                    *(b.column(at[c]).cast(pa.string()).to_pylist() for c in (lang, source)), b.column(at[n_chars]).cast(pa.float64()).to_pylist()
                )
                # As in fitting, where features travel in single precision.
                x, m = (v.astype(np.float32).astype(np.float64) for v in (text_features(b.column(at[text])), meta))
                found = model.scores(x, m)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found), pa.array(found[2] >= least)], [*kept, *NEW])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({c: F.lit(None).cast(t) for c, t in NEW.items()}).schema
    for field in schema:
        field.nullable = True
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, schema)
