"""Benchmark items without an id: op9 cannot name them, but documents that hold them are leaks."""

from weblens.llm import decontaminate
from weblens.llm.decontaminate import contaminated, item_blocks, without_leaks


def test_unnamed_items(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(12)]
    items = [(None if k < 8 else k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None), (None, "")]
    docs = [(k, f"before {t} after") for k, t in enumerate(texts)] + [(20, "nothing of that here at all"), (21, None), (22, texts[1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (None, 3):
        if block:
            monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block, False))
        assert sorted(r["doc_id"] for r in without_leaks(d, b).collect()) == [20, 21]
        assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(d, b).collect()) == [(k, k) for k in range(8, 12)]
    sizes = [len(index.ids) for index in item_blocks(b, block=3, unnamed=True)]
    assert sum(sizes) == len(items) and max(sizes) < len(items)
