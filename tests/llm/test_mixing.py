import re

import numpy as np
import pytest

from weblens.llm import mixing
from weblens.llm.mixing import _draw, hypergeometric, make_plan, mix, mixed_documents, permute, targets


def test_targets_are_reshared():
    assert targets([10, 1000, 1000], [1, 2, 3]) == pytest.approx([30, 792, 1188])
    assert targets([1, 1], [1, 3]) == [0.5, 1.5]
    assert targets([], []) == [] and targets([0, 5], [1, 2]) == [0.0, 5.0]
    sizes, weights = [5, 900, 60, 0, 44], [1, 2, 3, 1, 2]
    got = targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    there = permute(np.arange(n), n, (1, 2))
    assert sorted(there.tolist()) == list(range(n))
    assert permute(there, n, (1, 2), back=True).tolist() == list(range(n))


def test_shards_use_up_the_quotas():
    plan = make_plan([("a", 100_000), ("b", 3_000), (None, 50_000)], 16, 100)
    counts, before = np.zeros(3, dtype=int), np.zeros(3, dtype=int)
    for k in range(plan.shards):
        own, sofar = plan.shard(k)
        assert (sofar == before).all() and own.sum() == min(100, sum(plan.quotas) - 100 * k)
        before = before + own
    assert before.tolist() == plan.quotas


@pytest.mark.parametrize("good, bad, n", [(5, 7, 6), (40, 3, 20), (300, 5000, 900), (100_000, 100_000, 150_000)])
def test_own_draws_have_the_distribution_of_the_library(monkeypatch, good, bad, n):
    many = 20_000
    want = np.random.default_rng(1).hypergeometric(good, bad, n, many)
    monkeypatch.setattr(mixing, "_NUMPY_TOTAL", 0)
    rng = np.random.default_rng(2)
    got = np.array([hypergeometric(good, bad, n, rng) for _ in range(many)])
    cuts = np.unique(np.quantile(want, np.linspace(0, 1, 9)[1:-1]))
    for cut in cuts:
        assert abs((got <= cut).mean() - (want <= cut).mean()) < 0.02
    assert got.min() >= max(0, n - bad) and got.max() <= min(good, n)


def test_large_draws_are_draws():
    good, bad, n = 10**15, 3 * 10**15, 10**15
    rng = np.random.default_rng(0)
    found = np.array([hypergeometric(good, bad, n, rng) - 25 * 10**13 for _ in range(4000)], dtype=float)
    spread = (n * 0.25 * 0.75 * 0.75) ** 0.5
    assert abs(found.mean()) < 4 * spread / 4000**0.5 and abs(found.std() / spread - 1) < 0.05
    left = _draw(np.array([good, bad]), n, np.random.default_rng(0))
    assert left.sum() == n and left[0] != 25 * 10**13


def test_a_quota_of_any_size_meets_its_target():
    plan = make_plan([("a", 10**15 + 7), ("b", 4 * 10**14 + 1), ("c", 2 * 10**12)])
    for sid, aim in enumerate(plan.targets):
        assert abs(plan.taken(sid, plan.quotas[sid]) - aim) <= 64


def test_taken_agrees_with_slots_counted_one_by_one(spark):
    rows = [(i, "w " * (37 * i % 400), ["a", "b", None][i % 3]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, plan = mixing._placed(table, {})
    place = [(r["sid"], r["start"], r["size"], r["doc_id"]) for r in placed.collect()]
    want = dict.fromkeys(range(60), 0)
    for sid in range(3):
        n, used = plan.blocks[sid], [0] * plan.blocks[sid]
        for slot in range(plan.quotas[sid]):
            order = permute(np.arange(n), n, (sid, slot // n))
            used[order[slot % n]] += 1
        words = [d for s, _, size, d in sorted((p[0], p[1], p[2], p[3]) for p in place if p[0] == sid and p[2]) for _ in range(size)]
        for at, doc in enumerate(words):
            want[doc] += used[at // plan.block_words]
        assert sum(used[at // plan.block_words] for at in range(len(words))) == plan.taken(sid, plan.quotas[sid])
    assert {r["doc_id"]: r["taken"] for r in mix(table).collect()} == want


def test_no_column_is_lost(spark):
    names = ["_hash", "_start", "_source", "_doc_id", "_pieces", "key", "whole", "new", "start", "pieces", "text_hash", "row_hash", "sid", "block", "a.b"]
    kind = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names)
    rows = [(i // 2, f"one two three {i // 4}", "s", *(100 * i + k for k in range(len(names)))) for i in range(40)]
    table = spark.createDataFrame(rows, kind)
    out = mixed_documents(table)
    assert out.columns == table.columns
    got = {tuple(r)[3:]: r["doc_id"] for r in out.collect()}
    assert len(got) == 40 and all(got[r[3:]] == r[0] for r in rows)


def docs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        n = int(rng.choice([0, 3, 40, 300, 2000]))
        source = ["a", "b", "c", None, "dé"][int(rng.choice([0, 0, 0, 1, 2, 3, 4]))]
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(n)), source, "x"))
    rows += [(1000, None, "a", "x"), (1001, "tiny", "e", "x"), (7, "again", "a", "x"), (7, "again", "a", "x"), (None, "no id", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string"), rows


def test_mix(spark):
    table, rows = docs(spark)
    got = mix(table).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(words(r[1]) for r in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(aims[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in order:
        assert abs(taken[s] - aims[s]) <= 64
    again = mix(table.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"], r["size"])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and key


def test_texts_have_what_is_taken(spark):
    table, rows = docs(spark)
    taken = {}
    for r in mix(table).collect():
        taken.setdefault(r["doc_id"], []).append(r["taken"])
    out = mixed_documents(table)
    assert out.columns == table.columns
    found = {}
    for r in out.collect():
        found.setdefault(r["doc_id"], []).append(len(r["text"].split()))
    assert {k: sorted(v) for k, v in found.items()} == {k: w for k, v in taken.items() if (w := sorted(x for x in v if x))}
    whole = {r[0]: r[1] for r in rows if r[1]}
    for r in out.collect():
        assert set(r["text"].split()) <= set(whole[r["doc_id"]].split())


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(table).collect() == [] and mixed_documents(table).collect() == []
