import hashlib
import random

from pyspark.sql import functions as F

from weblens.llm.exact_dedup import exact_groups


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = [i for i in groups[t or ""] if i is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(7)
    parts = ["".join(rng.choice("abé😀 \n") for _ in range(8)) for _ in range(3)]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))[: rng.choice([3, 16, 100])]) for i in range(250)]
    return out + [(900, None), (901, ""), (None, out[3][1]), (None, None), (None, "only null ids"), (7, out[7][1]), (7, "another text of seven"), (7, out[7][1])]


def check(spark, **options):
    table = spark.createDataFrame([(d, t, "x") for d, t in rows()], "doc_id long, text string, name string")
    got = exact_groups(table, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows())


def test_blocks_and_pairs(spark):
    check(spark, block_chars=8)


def test_one_block(spark):
    check(spark)


def test_hash_collisions_are_told_apart(spark):
    check(spark, block_chars=8, hash_of=F.pmod(F.xxhash64("block"), F.lit(3)))


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_groups(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
