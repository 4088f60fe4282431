import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outflow.llm import conversation_repair as R
from outflow.llm import hash_tree as T
from outflow.llm import vector_codes as V

RNG = random.Random(12)

# ---------------------------------------------------------------- operator 11


def brute_shard(key, tree, seed=11):
    text = "-null" if key is None else f"+{key}"
    path, leaves = (), tree
    for field in ("region", "rack", "shard"):
        best = None
        for child in sorted({getattr(x, field) for x in leaves}):
            weight = sum(x.weight for x in leaves if getattr(x, field) == child)
            if weight > 0:
                name = "/".join(map(str, (seed, *path, child)))
                u = (int(hashlib.md5(f"{name}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                best = min(best or (math.inf, 0), (-math.log(u) / weight, child))
        path, leaves = (*path, best[1]), [x for x in leaves if getattr(x, field) == best[1]]
    return path


TREE = [T.Leaf(0, 0, 0, 2.0), T.Leaf(0, 0, 1), T.Leaf(0, 1, 2, 0.5), T.Leaf(1, 0, 3), T.Leaf(1, 0, 4, 3.0), T.Leaf(1, 1, 5, 0.0), T.Leaf(2, 0, 6)]


def placed(llm, ids, tree, **options):
    rows = llm.createDataFrame([(i, n % 7) for n, i in enumerate(ids)], "doc_id bigint, size bigint")
    return T.place(rows, tree, order=("doc_id", "size"), **options)


def test_shards_are_those_of_a_plain_descent(llm):
    ids = [None, *range(-3, 600), 2**60]
    rows = placed(llm, ids, TREE, after=T.grown(TREE)).collect()
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, TREE)[2]
        assert r.grown_shard == brute_shard(r.doc_id, T.grown(TREE))[2]
        assert r.grown_shard in (r.shard, 7)
    assert {r.shard for r in rows} == {0, 1, 2, 3, 4, 6}


def test_a_changed_weight_moves_rows_in_its_subtree_only(llm):
    heavier = [T.Leaf(x.region, x.rack, x.shard, x.weight * (4 if x.shard == 2 else 1)) for x in TREE]
    moved = 0
    for key in range(3000):
        was, now = brute_shard(key, TREE), brute_shard(key, heavier)
        if was != now:
            moved += 1
            assert now[:2] == (0, 1) or (was[0] != 0 and now[0] == 0)
        if was[0] != 0 and now[0] != 0:
            assert was == now
    assert moved


def test_shares_follow_weights(llm):
    tree = T.uniform(16)
    counts = {r.shard: r["count"] for r in placed(llm, range(16000), tree).groupBy("shard").count().collect()}
    assert len(counts) == 16 and all(800 < n < 1200 for n in counts.values())


def test_slots_have_no_gaps_with_a_third_null_and_a_third_equal_ids(llm):
    ids = [None] * 400 + [5] * 400 + list(range(400))
    rows = placed(llm, ids, T.uniform(16)).collect()
    for shard in range(16):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.size) for r in own]
        assert keys == sorted(keys)


def test_shard_columns_of_the_input_give_way_and_empty_tables_stay_empty(llm):
    rows = llm.createDataFrame([(1, 7, "x", 9)], "doc_id bigint, shard int, text string, _block int")
    out = T.place(rows, T.uniform(16))
    assert out.columns == ["doc_id", "text", "shard", "slot"] and out.first().slot == 0
    assert not T.place(rows.limit(0), T.uniform(16)).count()
    with pytest.raises(ValueError):
        T.place(rows, [T.Leaf(0, 0, 0, 0.0)])


def test_shards_are_written_whole(llm, tmp_path):
    out = placed(llm, range(300), T.uniform(16))
    T.write_shards(out, str(tmp_path / "shards"))
    back = llm.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, out.select("doc_id", "shard", "slot").collect()))


# ---------------------------------------------------------------- operator 12


def brute_repair(rows):
    """Every sequence of edits with at most one insertion between rows: (cost, audit, messages)."""
    n, best = len(rows), None
    faults, seen = [], set()
    for role, text in rows:
        solid = text.strip(R.BLANKS)
        faults.append("x" if not solid or (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    for edits in itertools.product(*[["D"] if f == "x" else ["D", "K", "Ru", "Ra"] for f in faults]):
        for inserts in itertools.product(["", "u", "a"], repeat=n + 1):
            cost, audit, said = 0, "", []
            for i in range(n + 1):
                if inserts[i]:
                    cost, audit = cost + 5, audit + "I"
                    said.append(({"u": "user", "a": "assistant"}[inserts[i]], ""))
                if i < n:
                    role, text = rows[i]
                    audit += edits[i][0]
                    if edits[i] == "D":
                        cost += 2
                        continue
                    cost += (edits[i] != "K") + 5 * (faults[i] == "t")
                    said.append((role if edits[i] == "K" else {"Ru": "user", "Ra": "assistant"}[edits[i]], text))
            letters = "".join(role[:1] for role, _ in said)
            rest = letters[1:] if letters[:1] == "s" else letters
            legal = (not letters) or (rest and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))
            if legal and all(role for role, _ in said) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, said
    return best


ROLES, TEXTS = ["user", "assistant", "system", "tool", "", "User", " "], ["Yes.", "No!", "cut", " ", "", "Why? \n", "x\x0b"]


def random_conversation(n):
    return [(RNG.choice(ROLES[:3] if RNG.random() < 0.8 else ROLES), RNG.choice(TEXTS)) for _ in range(n)]


def test_search_finds_the_cheapest_edits_and_the_least_audit():
    for _ in range(150):
        rows = random_conversation(RNG.randrange(0, 5))
        cost, audit, said = brute_repair(rows)
        seen, plain = set(), []
        for role, text in rows:
            plain.append((role[:1], R.fault(text, (role, text) in seen)[0]))
            seen.add((role, text))
        assert R.search(plain) == (cost, audit)
        assert [(m["role"], m["text"]) for m in R.messages(rows, R.START, audit)] == said
        loose = [[0.0] * 4 for _ in range(len(plain) + 1)]
        assert R.search(plain, bounds=loose) == (cost, audit)


def conversations(llm, chats):
    rows = [(c, t, role, text) for c, said in chats.items() for t, (role, text) in enumerate(said)]
    return llm.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_repair_agrees_with_brute_force_whatever_the_block(llm):
    chats = {c: random_conversation(RNG.randrange(1, 6)) for c in range(40)}
    got = {b: {r.conv_id: r for r in R.report(*R.repair_parts(conversations(llm, chats), bound=b)).collect()} for b in (2, 1024)}
    for c, rows in chats.items():
        cost, audit, said = brute_repair(rows)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
        for b in got:
            assert (got[b][c].cost, got[b][c].audit, got[b][c].repaired_sha256) == (cost, audit, digest)
    assert got[2] == got[1024]


def test_a_conversation_of_a_third_of_all_rows_lies_in_many_blocks(llm):
    words = ["a.", "b.", "c", "d?", ""]
    long = [("user" if RNG.random() < 0.5 else "assistant", f"{i % 170} {RNG.choice(words)}") for i in range(900)]
    rows = conversations(llm, {1: long, **{c: random_conversation(4) for c in range(2, 400)}}).unionByName(
        llm.createDataFrame([(None, None, "user", "same.")] * 700, "conv_id bigint, turn bigint, role string, text string")
    )
    parts = R.repair_parts(rows, bound=64)
    segments = R.repair(rows, bound=64)
    assert not parts[1].where("conv_id IS NOT NULL AND conv_id <> 1").count()
    assert segments.where("conv_id = 1").count() >= 900 // 64 and segments.agg(F.max(F.length("audit"))).first()[0] <= 2 * 64 + 2
    assert sorted(R.report(*parts).collect(), key=str) == sorted(R.report(*R.repair_parts(rows, bound=1024)).collect(), key=str)


def test_turns_gaps_nulls_and_extra_columns(llm):
    rows = llm.createDataFrame(
        [(1, 4, "user", "a.", 0), (1, None, None, None, 0), (1, 9, "assistant", "b.", 0), (1, 9, "assistant", "b.", 0), (None, None, "user", "q?", 1)],
        "conv_id bigint, turn bigint, role string, text string, cost int",
    )
    out = {r.conv_id: r for r in R.report(*R.repair_parts(rows)).collect()}
    assert (out[1].gaps, out[1].blank, out[1].duplicate, out[1].illegal, out[1].audit, out[1].cost) == (4, 1, 1, 2, "DKKD", 4)
    assert (out[None].gaps, out[None].audit, out[None].cost) == (0, "D", 2)
    assert not R.report(*R.repair_parts(rows.limit(0))).count()


def test_damage_follows_the_checksum(llm):
    rows = conversations(llm, {c: [("assistant", "One. Two!")] * 3 for c in range(60)})
    got = {}
    for r in R.damage(rows).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c in range(60):
        for t in range(3):
            hit = zlib.crc32(f"{c}:{t}".encode()) % 20
            whole = [("assistant", "One. Two!")]
            want = {0: None, 1: [("assistant", "")], 2: [("assistant", "One Two")], 3: whole * 2, 4: [("user", "One. Two!")]}.get(hit, whole)
            assert got.get((c, t)) == want


def test_long_conversations_are_searched_in_linear_time():
    rows = [(RNG.choice("ua"), RNG.choice([0, 0, 0, 1, 2])) for _ in range(1024)]
    bounds, looked = R.suffix_bounds(rows, R.WHOLE), []

    class Counted(list):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    R.search(rows, bounds=Counted(bounds))
    assert len(looked) < 20 * len(rows)


# ---------------------------------------------------------------- operator 13


def brute_codes(vectors, parts, entries, rounds):
    """Full search in plain integers. vectors: (vec_id, label, list of floats) in the order of ids."""
    whole = [[math.floor(256 * x) for x in v] for _, _, v in vectors]
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, books[p][e])), e))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in cut:
                held.setdefault(nearest(p, v[p]), []).append(v[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    codes = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum((a - b) ** 2 for p, e in enumerate(c) for a, b in zip(v[p], books[p][e])) for v, c in zip(cut, codes)]
    return ["".join(f"{e:02x}" for e in c) for c in codes], errors, books


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def vectors(n, dims=12, clusters=5, spread=0.2):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(clusters, dims))
    out = [(i, [float(np.float32(x)) for x in centres[i % clusters] + rng.normal(size=dims) * spread], [None, 1, 2][i % 3]) for i in range(n)]
    return [(i, v if i % 11 else out[min(5, n - 1)][1], label) for i, v, label in out]


@pytest.mark.parametrize("n,parts,entries,rounds", [(300, 4, 16, 2), (300, 3, 40, 6), (3, 4, 16, 2), (60, 12, 1, 2), (80, 2, 2, 0)])
def test_codes_are_those_of_a_full_search(llm, n, parts, entries, rounds):
    data = vectors(n)
    frame = llm.createDataFrame([(i, v, label, "x") for i, v, label in data], SCHEMA).repartition(5)
    got = V.compress(frame, parts=parts, entries=entries, rounds=rounds)
    codes, errors, books = brute_codes([(i, label, v) for i, v, label in data], parts, entries, rounds)
    rows = sorted(got.rows.collect(), key=lambda r: r.vec_id)
    assert [r.code for r in rows] == codes and [r.error for r in rows] == errors
    assert [b.tolist() for b in got.codebooks] == books
    totals = {}
    for (_, _, label), e in zip(data, errors):
        totals[label] = totals.get(label, 0) + e
    assert [r.label_error for r in rows] == [totals[label] for _, _, label in data]
    assert got.codebooks_sha256() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_bounds_spare_most_parts_and_fewer_entries_are_kept(llm):
    data = vectors(2000, spread=0.05)
    report = V.compress(llm.createDataFrame([(i, v, label, "x") for i, v, label in data], SCHEMA), parts=4, entries=32, rounds=4).bounds
    assert sum(report[-1]["looked"]) < 0.5 * 4 * 2000
    assert all(a >= b for a, b in zip(report[0]["kept"], report[-1]["kept"])) and sum(report[-1]["kept"]) < sum(report[0]["kept"])


def test_halved_bounds_are_on_the_safe_side():
    x = np.concatenate([np.random.default_rng(0).normal(size=4000) * 10.0 ** np.arange(-4, 4).repeat(500), [0.0, np.inf, 1e9, 65504.0, 65505.0, -1e9, 1e-9]])
    assert (V.down(x).astype(float) <= x).all() and (V.up(x).astype(float) >= x).all()


def test_vectors_that_take_no_part(llm):
    good = [(1, [0.5] * 8, 1, ""), (None, [-0.25] * 8, None, ""), (3, [1e30] * 8, 1, ""), (3, [0.5] * 8, 1, "")]
    bad = [(4, None, 1, ""), (5, [], 1, ""), (6, [float("nan")] * 8, 1, ""), (7, [float("inf")] + [0.0] * 7, 1, ""), (8, [None] + [0.0] * 7, 1, ""), (9, [0.5] * 9, 1, "")]
    got = V.compress(llm.createDataFrame(good + bad, SCHEMA), parts=4, entries=4)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got.rows.collect()) == [(False, 1), (False, 3), (False, 3), (True, 0)]
    assert {r.error for r in got.rows.collect()} == {0}
    empty = V.compress(llm.createDataFrame(bad[:5], SCHEMA), parts=4)
    assert not empty.rows.count() and empty.codebooks_text() == ""
