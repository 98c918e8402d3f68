"""Items of few shingles against brute force."""

import random

from tests.llm.test_decontaminate import brute
from weblens.llm.decontaminate import ItemIndex


def test_short_items_in_long_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(5 + i % 8)) for i in range(800)]  # one to eight shingles
    items += [(800, items[0][1]), (801, "too short"), (802, "")]
    docs = []
    for k in range(200):
        body = text(rng.choice([100, 1500])).split()
        for i, x in rng.sample(items[:800], 12):
            passage = x.split()
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage if rng.random() < 0.7 else passage[:-1] if i % 2 else passage[2:]
        docs.append(" ".join(body))
    docs += ["too short", "that is too short a text", ""]
    got = ItemIndex(items).contained(docs, 0.8)
    assert sorted(got, key=str) == brute(list(enumerate(docs)), items) and len(got) > 1500


def test_recall_by_item_length():
    """Items of 1 to 20 shingles, each in a long text, at any place of a stride."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(n * 1000 + k, " ".join(word() for _ in range(n + 4))) for n in range(1, 21) for k in range(40)]
    texts = []
    for _, item in items:
        before = rng.randint(0, 600)
        texts.append(" ".join([*(word() for _ in range(before)), item, *(word() for _ in range(600 - before))]))
    found = {(text, item) for text, item, _, _ in ItemIndex(items).contained(texts, 0.8)}
    assert found == {(text, item) for text, (item, _) in enumerate(items)}
