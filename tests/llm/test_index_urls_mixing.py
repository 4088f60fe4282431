import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from outflow.llm.mixing import apportion, mix
from outflow.llm.permutation_index import search
from outflow.llm.url_filter import RULES, judge_urls
from tests.llm import brute

RNG = random.Random(6)


def nearest(vectors, k=10):
    out = {}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    for i in ids:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(vectors[i], float)) ** 2).sum(1))
            out[i] = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(4096, 2048), (500, 7)])
def test_index_recall_and_ties(llm, shard_rows, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    for i in range(0, 900, 3):
        vectors[i] = vectors[0]
    df = llm.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in search(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = nearest(vectors)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert np.mean([len({v for _, v in got[q]} & {v for _, v in want[q]}) / 10 for q in want]) >= 0.9
    assert [v for _, v in got[0]] == list(range(3, 33, 3))
    for q, found in got.items():
        assert found == sorted(found)
        for score, v in found:
            assert score == np.sqrt(((np.array(vectors[v], float) - np.array(vectors[q], float)) ** 2).sum())


def test_index_edge_rows(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, None, 1), (6, [], 1), (7, [1.0, None], 1),
        (8, [1.0, 2.0, 3.0], 1), (9, [4.0, 4.0], 1), (9, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (200, [0.0, 0.0], 1),
    ]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = [tuple(r) for r in search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 1.0), (0, 3, 100, 1.0), (100, 1, 9, 0.0), (100, 2, 0, 1.0), (100, 3, 1, 1.0)]
    assert search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return brute.lower(host), re.match(r"[^?#]*", rest[len(host):])[0]


def test_hosts_paths_and_rules(llm):
    urls = [
        None, "", "no scheme/x", "http://", "HTTP://Example.NET/en/1?q#f", "https://a.b.example.net/en/", "http://example.net/en", "http://notexample.net/en/",
        "http://example.com/de/x", "http://x.example.com/de", "http://example.org/fr/1", "http://org/fr/", "http://Ünï.ORG/fr/é", "http://a?b://c/d", "http://h:80/#/x",
        "ftp://example.net#x", "x://y://z/w", "http://example.net\n/en/",
    ]
    pages = llm.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[4], 1)], "page_id bigint, url string, rule int")
    out = judge_urls(pages, llm.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        host, path = url_by_hand(urls[r["page_id"]]) if r["rule"] is None or r["page_id"] else url_by_hand(urls[4])
        if r["page_id"] == 0:
            continue
        assert (r["host"], r["path"]) == (host, path)
        fits = [
            (len(text), text, says) for says, text in RULES
            if (host == text.split("/")[0] or host.endswith("." + text.split("/")[0])) and path.startswith("/" + text.split("/", 1)[1])
        ]
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "allow")


def test_templates_generalise_and_reject(llm):
    pages, labels = [], []
    for i in range(600):
        part = ("news", "spam", "shop", "blog")[i % 4]
        pages.append((i, f"https://h.example/{part}/{i}.html"))
        if i % 2 == 0 or part == "spam":
            labels.append((i, int(part != "spam" and i % 40 != 0)))
    pages += [(1000 + i, f"https://other.example/spam/{i}") for i in range(50)]
    out = {r["page_id"]: r for r in judge_urls(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert {r["template"] for r in out.values()} == {f"h.example/{p}/*.html" for p in ("news", "spam", "shop", "blog")} | {"other.example/spam/*"}
    assert {i for i, r in out.items() if r["verdict"] == "block"} == {i for i in range(600) if i % 4 == 1}
    assert judge_urls(llm.createDataFrame([], "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_a_leaf_without_labels_joins_no_branch(llm):
    # The files lie right under the host, so that they are leaves of one parent.
    pages, labels = [], []
    for name, n, labelled, good in (("spam", 50, 50, 0), ("quiet", 20, 0, 0), ("news", 100, 100, 100)):
        for i in range(n):
            pages.append((len(pages), f"http://h.io/{name}"))
            if i < labelled:
                labels.append((len(pages) - 1, int(i < good)))
    out = judge_urls(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int"), rules=())
    verdict = {r["path"]: r["verdict"] for r in out.collect()}
    assert verdict == {"/spam": "block", "/quiet": "allow", "/news": "allow"}


def test_neighbours_do_not_chain(llm):
    pages, labels = [], []
    for leaf in range(11):
        for i in range(20):
            pages.append((len(pages), f"http://h.io/leaf{leaf}"))
            labels.append((len(pages) - 1, int(i < 2 * leaf)))
    out = judge_urls(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int"), rules=())
    verdict = {r["path"]: r["verdict"] for r in out.collect()}
    assert verdict["/leaf0"] == verdict["/leaf1"] == "block" and verdict["/leaf9"] == verdict["/leaf10"] == "allow"


def test_a_small_section_of_a_hot_host_is_told_apart(llm):
    """60 sections of a sixtieth of the pages each; one is bad. Below, two branches of twelve segments differ in the tenth."""
    pages, labels = [], []
    for name in ["s%d/a" % i for i in range(60)] + ["deep/2/3/4/5/6/7/8/9/good/x", "deep/2/3/4/5/6/7/8/9/bad/x"]:
        for _ in range(12):
            pages.append((len(pages), f"http://h.io/{name}"))
            labels.append((len(pages) - 1, int(not name.startswith("s7/") and "bad" not in name)))
    out = judge_urls(llm.createDataFrame(pages, "page_id bigint, url string"), llm.createDataFrame(labels, "doc_id bigint, quality int"), rules=())
    assert {r["path"] for r in out.collect() if r["verdict"] == "block"} == {"/s7/a", "/deep/2/3/4/5/6/7/8/9/bad/x"}


def test_urls_with_deep_paths_and_bad_labels(llm):
    pages = llm.createDataFrame([(1, "http://h/" + "a/" * 300), (1, "http://h/" + "a/" * 300), (None, "http://h//x//")], "page_id bigint, url string")
    labels = llm.createDataFrame([(1, None), (1, 0), (1, 1), (None, 0)], "doc_id bigint, quality int")
    assert judge_urls(pages, labels).count() == 3


@pytest.mark.parametrize("seed", range(6))
def test_seats_by_highest_quotients(llm, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for key in range(4):
        units = {u: float(rng.choice([0, 1, 1, 2, 7, rng.randrange(1, 5000), 1e6])) for u in range(rng.randrange(1, 30))}
        seats = rng.choice([0, 1, 3, 17, 200])
        got = brute.sainte_lague(units, seats) if sum(units.values()) else {}
        want.update({(key, u): got.get(u, 0) for u in units})
        rows += [(key, u, w, seats) for u, w in units.items()]
    out = apportion(llm.createDataFrame(rows, "key int, unit int, w double, seats bigint"), "key", "unit", "w", "seats").collect()
    assert {(r["key"], r["unit"]): r["quota"] for r in out} == want


@pytest.fixture(scope="module")
def mixed(documents):
    texts = [" ".join(["w"] * RNG.choice([0, 1, 5, 90, 700, 3000])) for _ in range(400)] + [None, "w " * 20000]
    sources = [RNG.choice(["b", "a", "ä", "Z", None, "hot", "hot", "hot", "hot"]) for _ in texts]
    return texts, sources, documents(texts, source=sources)


def test_mix_meets_targets(mixed):
    texts, sources, docs = mixed
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    want = brute.targets(dict(sizes), (3, 1, 2), 1.5, 2.0)
    out = mix(docs, shard_words=20_000).collect()
    assert len(out) == len(texts)
    taken = defaultdict(int)
    for r in out:
        s = sources[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(x["to"] - x["from"] for x in r["ranges"])
        assert all(0 <= x["from"] < x["to"] <= r["size"] for x in r["ranges"])
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.03, abs=200), s


def test_mix_repeats_itself(mixed):
    _, _, docs = mixed
    one = {r["doc_id"]: r["taken"] for r in mix(docs).collect()}
    assert one == {r["doc_id"]: r["taken"] for r in mix(docs.repartition(7)).collect()}
    assert one != {r["doc_id"]: r["taken"] for r in mix(docs, seed=3).collect()}


def test_mix_edge_rows(llm):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "a b", "x", 1), (2, "", "y", 1), (3, "c " * 500, "x", 1), (3, "c " * 500, "x", 1)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, source string, taken int")
    out = mix(docs).collect()
    assert len(out) == 6 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mix(docs.where("text IS NULL")).collect())


def test_the_search_for_seats_reads_shards_that_are_written_down(mixed, monkeypatch):
    from outflow.llm import mixing

    plans, whole = [], mixing.apportion

    def seen(items, *names):
        plans.append(items._jdf.queryExecution().optimizedPlan().toString())
        return whole(items, *names)

    monkeypatch.setattr(mixing, "apportion", seen)
    mix(mixed[2], shard_words=20_000)
    assert len(plans) == 2 and not any("Join" in p for p in plans)
