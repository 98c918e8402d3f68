import random

from weblens.llm.decontaminate import contaminated, item_blocks, plain_words, without_leaks


def shingles(text):
    w = [x.decode() for x in plain_words(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, items, least=0.8):
    out = []
    for i, t in docs:
        own = shingles(t)
        for j, x in items:
            asked = shingles(x)
            if j is not None and asked and len(asked & own) >= least * len(asked):
                out.append((i, j, len(asked & own), len(asked)))
    return sorted(out, key=str)


def make(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([6, 14, 30, 70, 200, 900]))) for i in range(60)]
    items += [(100, "too short"), (101, ""), (102, None), (None, text(20)), (103, items[0][1])]
    docs = []
    for k in range(150):
        body = text(rng.choice([0, 3, 50, 400, 6000])).split()
        if k % 2:
            passage = rng.choice(items[:60])[1].split()
            cut = passage[: max(1, int(len(passage) * rng.choice([0.5, 0.85, 1.0])))]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + "," if rng.random() < 0.3 else w for w in cut]
            if k % 10 == 1:
                half = len(passage) // 2  # in two places
                body = body + passage[:half] + text(500).split() + passage[half:]
        docs.append((k, " ".join(body)))
    return docs + [(900, None), (901, ""), (902, "Too short"), (1, docs[1][1])], items


def test_against_brute_force(spark):
    docs, items = make()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(d, b).select("doc_id", "item_id", "n_common", "n_item").collect()
    want = brute(docs, items)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len(want) > 40
    kept = without_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})


def test_items_in_blocks(spark):
    _, items = make()
    b = spark.createDataFrame(items, "item_id long, text string")
    ids = [i for index in item_blocks(b, block=10) for i in index.ids]
    assert sorted(ids) == sorted(i for i, _ in items if i is not None)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contaminated(none, items).collect() == []
    assert contaminated(some, items).collect() == []
    assert without_leaks(some, items).count() == 1
