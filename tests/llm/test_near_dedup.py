import random
import re

from weblens.llm.components import connected_components
from weblens.llm.near_dedup import near_components, one_of_each


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows, k = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 12, 60, 150, 400]))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            text = (" " if rng.random() < 0.5 else "\n").join(copy)
            rows.append((k, text.upper() if rng.random() < 0.2 else text))
            k += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = families(1) + [(5000, None), (5001, ""), (5002, " \n"), (None, "one two"), (6000, "one two"), (None, "alone"), (None, "é É x y z w"), (7, "a b")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = near_components(table).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=str) == [(d, n, c, k) for d, n, c, k in want]
    assert sum(d != c for d, _, c, _ in want) > 40


def test_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr("weblens.llm.near_dedup.BLOCK", 8)
    monkeypatch.setattr("weblens.llm.near_dedup.WIDE_BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(9, 9)]
    up = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in links)}


def test_one_of_each(spark):
    rows = families(3) + [(5000, None), (5001, ""), (6000, "one two"), (6000, "one two"), (0, "the same id but another text")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = one_of_each(table)
    assert got.columns == table.columns
    want = {(d, t) for (d, t), c in zip(rows, [x for x in _components(rows)], strict=True) if d == c}
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def _components(rows):
    of = {}
    for d, n, c, k in [tuple(x) for x in brute_in_order(rows)]:
        of.setdefault(d, []).append(c)
    return [of[d].pop(0) for d, _ in rows]


def brute_in_order(rows):
    tagged = [(k, t) for k, (_, t) in enumerate(rows)]
    return [(d, *_one(rows, tagged, k)) for k, (d, _) in enumerate(rows)]


_MEMO = {}


def _one(rows, tagged, k):
    if id(rows) not in _MEMO:
        _MEMO[id(rows)] = {d: (n, c) for d, n, c, _ in brute(tagged)}
    n, c = _MEMO[id(rows)][k]
    members = [i for i in range(len(rows)) if _MEMO[id(rows)][i][1] == c]
    least = min(rows[i][0] for i in members) if n else rows[k][0]
    return n, least, least == rows[k][0]


def test_empty(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_column_is_lost(spark):
    names = ["_hash", "_text_hash", "_id", "_again", "again", "whole", "hash", "id", "text_hash", "k"]
    kind = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names)
    rows = [(i, f"the same words in all {i // 3}", *(100 * i + k for k in range(len(names)))) for i in range(30)]
    rows += [(0, rows[0][1], *(7 for _ in names))]
    table = spark.createDataFrame(rows, kind)
    out = one_of_each(table)
    assert out.columns == table.columns
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 30, 3))
    assert all(tuple(r) in rows for r in got)


def test_differing_symbols(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from weblens.llm.near_dedup import _differing

    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**16, size=(200, 8), dtype=np.uint16)
    b = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 2**16, size=a.shape, dtype=np.uint16))
    b[0], b[1] = a[0] ^ 0x8000, a[1] ^ 1
    rows = [tuple(int(v) for v in (*x.view("<i8"), *y.view("<i8"), (x != y).sum())) for x, y in zip(a, b, strict=True)]
    got = spark.createDataFrame(rows, "a0 long, a1 long, b0 long, b1 long, want long")
    found = _differing([F.col("a0"), F.col("a1")], [F.col("b0"), F.col("b1")])
    assert got.where(found != F.col("want")).count() == 0
