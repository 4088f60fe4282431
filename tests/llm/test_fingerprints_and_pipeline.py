import hashlib
import random

import pytest

import corpus_pipeline
import outflow.llm.imatch as imatch
from outflow.llm.imatch import fingerprints
from outflow.llm.substring_dedup import remove_repeats
from tests.llm import brute

RNG = random.Random(3)
VOCABULARY = ["w%d" % i for i in range(300)] + ["Éé", "ß", "日本"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@pytest.fixture(scope="module")
def texts():
    out = [prose(RNG.randrange(20, 120)) for _ in range(60)]
    out[3], out[20], out[21] = None, "", "😀é"
    out[40] = out[41] = out[5]
    out[50] = out[5].replace(" ", "\n \t")
    out[51] = prose(8000)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 23, 3000])
def test_edited_texts_follow_the_next_document(documents, texts, monkeypatch, block_bytes):
    monkeypatch.setattr(imatch, "BLOCK_BYTES", block_bytes)
    out = {r["doc_id"]: r for r in fingerprints(documents(texts).repartition(4), high=0.5).collect()}
    plain = [t or "" for t in texts]
    assert len(out) == len(plain)
    for i, t in enumerate(plain):
        r = out[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited(t, plain[(i + 1) % len(plain)]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert out[5]["fingerprint"] == out[40]["fingerprint"] == out[41]["fingerprint"] == out[50]["fingerprint"]
    assert out[40]["near_next"] == 1.0
    assert len({r["fingerprint"] for r in out.values()}) == len(out) - 4
    rest = [i for i in range(60) if len(plain[i]) > 100 and i not in (40, 41)]
    assert sum(out[i]["near_edited"] for i in rest) > 2 * sum(out[i]["near_next"] for i in rest)


def test_near_next_is_the_next_rows_own_fingerprint(documents, texts, monkeypatch):
    whole = {r["doc_id"]: r for r in fingerprints(documents(texts)).collect()}
    monkeypatch.setattr(imatch, "BLOCK_BYTES", 2500)
    for r in fingerprints(documents(texts)).collect():
        assert tuple(r) == tuple(whole[r["doc_id"]])


def test_fingerprint_edge_rows(llm):
    rows = [(None, "a b", 1), (4, None, 1), (4, None, 1), (4, "x", 1), (9, "a b", 1)]
    out = fingerprints(llm.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")).collect()
    assert len(out) == 5
    prints = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in out}
    assert prints[(None, 3)] == prints[(9, 3)]
    one = fingerprints(llm.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert fingerprints(llm.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_lexicon_keeps_the_band(documents):
    docs = documents(["common mid rare1", "common mid x", "common y", "common z"])
    terms = {r["term"] for r in imatch.lexicon(docs, "text", 0.0, 0.5).collect()}
    (mid,) = documents(["mid"]).selectExpr("xxhash64(text) h").first()
    assert terms == {mid}


def test_stages_by_brute_force(llm, documents, tmp_path):
    base, passage = prose(200), prose(60)
    near = base.split(" ")
    near[7] = "changed"
    texts = [prose(80) for _ in range(20)] + [base, base, " ".join(near), prose(30) + " " + passage, prose(30) + " " + passage, None, ""]
    texts += [" | ".join(w.upper() + "!!" for w in prose(40).split()) for _ in range(12)]
    docs = documents(texts, source=["s%d" % (i % 3) for i in range(len(texts))])
    labels = llm.createDataFrame([(i, int(i < 27)) for i in range(len(texts)) if i % 3], "doc_id bigint, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frames = [llm.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(llm, frames[-1], str(tmp_path)).write.parquet(out)
        frames.append(llm.read.parquet(out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames[-1].columns == corpus_pipeline.COLUMNS
    rows = [sorted(f.collect(), key=lambda r: (r["doc_id"], r["text"] or "")) for f in frames]
    assert not {r["doc_id"] for r in rows[1]} & set(range(27, 39)) and set(range(25)) <= {r["doc_id"] for r in rows[1]}
    found = brute.classes([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert [r["doc_id"] for r in rows[2]] == [r["doc_id"] for r, (_, c) in zip(rows[1], found) if c == r["doc_id"]]
    kept = brute.kept_words([(r["doc_id"], r["text"]) for r in rows[2]], 20)
    want = {r["doc_id"]: " ".join(w) for r, w in zip(rows[2], kept) if w or not brute.WORD.findall(r["text"] or "")}
    assert {r["doc_id"]: " ".join(brute.WORD.findall(r["text"])) for r in rows[3]} == want
    sizes = {}
    for r in rows[3]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    goal = brute.targets(sizes, (3, 1, 2), 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in rows[4]:
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    # Half a block by rounding, and a short last block.
    assert all(taken[s] == pytest.approx(goal[s], abs=96) for s in sizes)
    assert [(r["doc_id"], r["text"]) for r in rows[5]] == [(r["doc_id"], r["text"]) for r in rows[4]]
    assert all(r["n_ids"] == len(r["ids"]) > 0 and r["round_trip"] for r in rows[5])
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == len(rows[5])


def test_stages_on_empty_tables(llm, documents, tmp_path):
    docs = documents(["a"]).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0
    assert remove_repeats(docs).count() == 0


def test_near_copies_are_rows_whatever_their_ids(llm):
    a, b, c = prose(120), prose(120), prose(120)
    near = " ".join(["changed", *b.split(" ")[1:]])
    # Copies without an id, a second row of one id, a class without any id, rows without words.
    texts = [(5, a), (None, a), (5, a), (3, b), (None, near), (None, c), (None, c), (9, c.upper()), (5, prose(90)), (None, None), (None, ""), (8, " ")]
    rows = [(i, t, "en", f"s{n}", 1, n) for n, (i, t) in enumerate(texts)]
    rows += [(None, d, "en", "x", 1, 0) for d in [prose(80)] * 3]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, uid int")
    out = corpus_pipeline.near_copies(llm, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["source"]) for r in out.collect()), key=str)
    kept = [(i, f"s{n}") for n, (i, _) in enumerate(texts) if n not in (1, 2, 4, 5, 6)] + [(None, "x")]
    if (False, 5, "s0") not in got:
        kept[0] = (5, "s2")
    assert got == sorted(((i is None, i, s) for i, s in kept), key=str)


def test_near_copies_write_no_texts_down(llm, monkeypatch):
    written = []
    monkeypatch.setattr(corpus_pipeline, "durable", lambda df, keep=corpus_pipeline.durable: written.append(df.columns) or keep(df))
    text = prose(60)
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, prose(60), "en", "s", 1)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(llm, docs, "").collect()) == [1, 3]
    assert not [c for c in written if "text" in c]


def test_mixture_keeps_rows_of_one_id_apart(llm):
    rows = [(i, f"r{n} " * 100, "en", "s", 300) for n, i in enumerate([None] * 6 + [7] * 6)]
    out = corpus_pipeline.mixture(llm, llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()
    words = [w for r in out for w in r["text"].split()]
    assert 0 < len(words) <= 2 * 1200 and max(words.count(w) for w in set(words)) <= 200


def near_copy_corpus(n, copies):
    """``copies`` near copies of one text of 200 words, two words changed in each, among other texts of 200 words."""
    rng = random.Random(copies)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    out = []
    for i in range(n):
        own = base.copy() if i < copies else [rng.choice(words) for _ in range(200)]
        if i < copies:
            for _ in range(2):
                own[rng.randrange(200)] = f"new{i}x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_copies_are_seen_however_many_there_are(documents):
    likeness = {}
    for copies in (60, 300):
        out = {r["doc_id"]: r for r in fingerprints(documents(near_copy_corpus(900, copies))).collect()}
        likeness[copies] = sum(out[i]["near_next"] for i in range(copies - 1)) / (copies - 1)
        others = [out[i] for i in range(copies + 1, 899)]
        assert sum(r["near_next"] for r in others) / len(others) < 0.1
        edited_copies = sum(out[i]["near_edited"] for i in range(copies - 1)) / (copies - 1)
        assert edited_copies >= sum(r["near_edited"] for r in others) / len(others)
        shared = [set(out[i]["fingerprint"].split("-")) - {""} for i in range(copies)]
        assert all(len(shared[i] & shared[i + 1]) > 5 for i in range(copies - 1))
    assert likeness[60] > 0.8 and likeness[300] > 0.8


def spark_hash(values):
    """Spark's xxhash64 of longs or an int at the end, from its seed on."""
    import xxhash

    seed = 42
    for value, size in values:
        seed = xxhash.xxh64(value.to_bytes(size, "little", signed=True) if isinstance(value, int) else value.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute_fingerprints(texts, low, high, rates, each, common_rates, few):
    import re

    own = [{w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w} for t in texts]
    df = {}
    for words in own:
        for w in words:
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    common = {w for w, c in df.items() if c >= max(2.0, low * n) and c > max(2.0, high * n)}
    band = {w for w, c in df.items() if max(2.0, low * n) <= c <= max(2.0, high * n)}

    def levels(text):
        words = {w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}
        out = []
        for lexicon, some in ((band, rates), (common, common_rates)):
            terms = sorted(spark_hash([(w, 0)]) for w in words & lexicon)
            for r in some:
                parts = [[t for t in terms if spark_hash([(t, 8), (r, 4)]) & ((1 << r) - 1) == i] for i in range(min(each, 1 << r))]
                out.append([(spark_hash([(t, 8) for t in p]) % (1 << 64)) >> 32 if p else None for p in parts])
        return len(words & band), len(words & band) + len(words & common), out

    def printed(text):
        _, n_terms, all_levels = levels(text)
        if not n_terms:
            return "t" + hashlib.sha256(text.encode()).hexdigest()
        return "-".join("" if h is None else format(h, "x") for level in all_levels for h in level)

    def near(a, b):
        if printed(a) == printed(b):
            return 1.0
        (n_a, _, x), (n_b, _, y) = levels(a), levels(b)
        used = equal = last = 0
        for i, (p, q) in enumerate(zip(x, y)):
            n_used = sum(h is not None or k is not None for h, k in zip(p, q))
            if i >= len(rates) and min(n_a, n_b) >= few:
                n_used = 0
            same = sum(h is not None and h == k for h, k in zip(p, q))
            if n_used and 4 * n_used <= 3 * len(p):
                used, equal = used + n_used, equal + same
            last = same / n_used if n_used else last
        return equal / used if used else last

    return printed, near


def test_fingerprints_and_likeness_by_brute_force(documents, texts):
    knobs = dict(low=0.05, high=0.3, rates=(1, 3, 5), each=8, common_rates=(2, 4), few=12)
    some = [t or "" for t in texts if t is None or len(t) < 5000][:40] + near_copy_corpus(12, 6)
    printed, near = brute_fingerprints(some, **knobs)
    out = {r["doc_id"]: r for r in fingerprints(documents(some), **knobs).collect()}
    for i, t in enumerate(some):
        after = some[(i + 1) % len(some)]
        assert out[i]["fingerprint"] == printed(t)
        assert out[i]["edited_fingerprint"] == printed(edited(t, after))
        assert out[i]["near_edited"] == pytest.approx(near(t, edited(t, after)))
        assert out[i]["near_next"] == pytest.approx(near(t, after))
