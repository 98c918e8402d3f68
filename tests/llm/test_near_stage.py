"""The near-duplicate stage at its own similarity, 0.80, and the distance that follows from a similarity."""

import math
import random

import corpus_pipeline
import numpy as np
import pytest

from weblens.llm import near_dedup
from weblens.llm.near_dedup import _COLUMNS, SYMBOLS, _keys, distance
from tests.llm.test_near_dedup import brute


def pairs_around(seed, pairs=60):
    """Pairs of texts of 204 words; a changed word in the middle changes five of their 200 shingles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for k in range(pairs):
        base = [word() for _ in range(204)]
        other = list(base)
        for at in range(20, 20 + 10 * (3 + k % 4), 10):  # 3 to 6 words: similarities 0.86, 0.82, 0.78, 0.74
            other[at] = "changed" + str(at)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return rows


def test_stage_at_80(spark, sf):
    rows = pairs_around(5)
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, sf).collect())
    assert got == [d for d, _, _, kept in sorted(brute(rows, 80)) if kept]
    assert len(got) == len([1 for *_, kept in brute(rows, 85) if kept]) - 15  # what 85 would leave in


@pytest.mark.parametrize("percent", [60, 70, 80, 85, 90, 100])
def test_distance_and_keys(spark, percent):
    most = distance(percent)
    tail = lambda d: sum(math.comb(SYMBOLS, k) * (1 - percent / 100) ** k * (percent / 100) ** (SYMBOLS - k) for k in range(d + 1, SYMBOLS + 1))
    assert tail(most) <= near_dedup.MISSED and (most == 0 or tail(most - 1) > near_dedup.MISSED)
    rng = np.random.default_rng(percent)
    rows = []
    for k in range(100):  # pairs with `most` different symbols, in places of all kinds
        a = rng.integers(0, 2**16, size=SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[rng.permutation(SYMBOLS)[:most]] ^= np.uint16(1)
        rows += [(2 * k + i, *x.view(np.int64).tolist()) for i, x in enumerate((a, b))]
    table = spark.createDataFrame(rows, "vid long, " + ", ".join(f"{c} long" for c in _COLUMNS))
    keys = {}
    for r in _keys(table, percent).collect():
        keys.setdefault(r["vid"], set()).add(r["key"])
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(100))
    assert (distance(85), distance(80)) == (15, 18)
