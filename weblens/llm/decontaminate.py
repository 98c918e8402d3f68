"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are to be found inside long documents, where the Jaccard similarity of the two is
near zero. So items are partitioned by the size of their shingle sets, and each partition looks at documents through windows
of a size to match: strides as long as the partition's largest set, two strides to a window. An item of the partition that
a document holds in one passage has a Jaccard similarity of 0.19 or more with one of its windows, and is missed by HASHES
hashes with a probability below 2e-6. The minima of longer windows are minima of shorter ones, so each shingle is hashed once.
Candidates are verified by the exact containment of the item's shingles in the whole document's.
The shortest windows are too wide for that bound to hold for items of SHORT shingles or fewer: every document shingle is
looked up in a table of theirs, which is exact.

Items are the stated query set. They are read in blocks of bounded size, and documents are scanned once for
each block; no document is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import map_rows, text_or_empty, text_test
from weblens.llm.shingles import minima, sequences

HASHES, SEED = 64, 9
#: Items in a block, which bounds what is sent to every task.
BLOCK_ITEMS = 20_000
#: Shingles in the shortest stride.
STRIDE = 16
#: Shingles up to which an item is looked up exactly; larger sets fill more than half of a stride.
SHORT = STRIDE // 2
_BITS = 20

_BLANK = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, which separates words like blanks."""
    return text.lower().encode("utf-8", "replace").translate(_BLANK).split()


@dataclass
class _Partition:
    """Items whose sets fit one stride: MinHash values of all of them, sorted for each hash."""

    blocks: int
    values: np.ndarray
    items: np.ndarray
    filled: np.ndarray


class ItemIndex:
    """MinHash index of a block of items, partitioned by the size of their shingle sets."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(s) for s in sequences([plain_words(t or "") for _, t in items])]
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self._index_short(np.flatnonzero((sizes > 0) & (sizes <= SHORT)))
        sizes[sizes <= SHORT] = 0
        low = minima(self.sets, HASHES, SEED)
        self.partitions: list[_Partition] = []
        blocks = 1
        while (sizes > 0).any():
            own = np.flatnonzero((sizes > 0) & (sizes <= STRIDE * blocks))
            if len(own):
                order = np.argsort(low[own], axis=0, kind="stable")
                values = np.take_along_axis(low[own], order, axis=0)
                filled = np.zeros(1 << _BITS, dtype=bool)
                filled[values.ravel() & np.uint64((1 << _BITS) - 1)] = True
                self.partitions.append(_Partition(blocks, values, own[order], filled))
                sizes[own] = 0
            blocks *= 2
        rng = np.random.default_rng(SEED)
        self.turns = rng.integers(0, 2**64, size=HASHES, dtype=np.uint64)
        self.factors = rng.integers(0, 2**64, size=HASHES, dtype=np.uint64) | np.uint64(1)

    def _index_short(self, own: np.ndarray) -> None:
        """The table of all shingles of short items, sorted, with their items beside them."""
        shingles = np.concatenate([np.zeros(0, dtype=np.uint64), *(self.sets[i] for i in own)])
        order = np.argsort(shingles, kind="stable")
        self.short = shingles[order]
        self.short_items = np.repeat(own, [len(self.sets[i]) for i in own])[order]
        self.short_filled = np.zeros(1 << _BITS, dtype=bool)
        self.short_filled[self.short & np.uint64((1 << _BITS) - 1)] = True

    def short_matches(self, texts: list[np.ndarray], least: float) -> list[tuple[int, int, int]]:
        """(text, item, shingles in common) of all short items that a text contains."""
        out = []
        for text, whole in enumerate(texts) if len(self.short) else ():
            maybe = np.unique(whole[self.short_filled[whole & np.uint64((1 << _BITS) - 1)]])
            lo, hi = (np.searchsorted(self.short, maybe, side=side) for side in ("left", "right"))
            found = [self.short_items[a:b] for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True)]
            if found:
                for item, common in zip(*(x.tolist() for x in np.unique(np.concatenate(found), return_counts=True)), strict=True):
                    if common >= least * len(self.sets[item]) - 1e-9:
                        out.append((text, item, common))
        return out

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs of longer items that share the minimum of some hash in some window."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        full = np.flatnonzero(sizes)
        if not len(full) or not self.partitions:
            return set()
        flat = np.concatenate([texts[i] for i in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        strides = -(-sizes[full] // STRIDE)
        owner = np.repeat(full, strides)
        first = np.cumsum(strides) - strides
        inside = np.arange(len(owner)) - np.repeat(first, strides)
        begins = np.repeat(at, strides) + inside * STRIDE
        merged = {1: (np.arange(len(owner)), owner)}
        for p in self.partitions:  # starts of longer strides among the shortest ones
            if p.blocks > 1:
                keep = np.flatnonzero(inside % p.blocks == 0)
                merged[p.blocks] = (keep, owner[keep])
        found: set[tuple[int, int]] = set()
        for k in range(HASHES):
            low = np.minimum.reduceat((flat ^ self.turns[k]) * self.factors[k], begins)
            for p in self.partitions:
                keep, whose = merged[p.blocks]
                stride = low if p.blocks == 1 else np.minimum.reduceat(low, keep)
                window = stride.copy()
                same = whose[1:] == whose[:-1]
                window[:-1][same] = np.minimum(stride[:-1][same], stride[1:][same])
                maybe = np.flatnonzero(p.filled[window & np.uint64((1 << _BITS) - 1)])
                if not len(maybe):
                    continue
                value = window[maybe]
                lo = np.searchsorted(p.values[:, k], value, side="left")
                hi = np.searchsorted(p.values[:, k], value, side="right")
                for w, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.update((int(whose[w]), int(item)) for item in p.items[a:b, k])
        return found

    def contained(self, texts: list[str], least: float) -> list[tuple[int, int, int, int]]:
        """(text, item id, shingles in common, shingles of the item) where the containment is `least` or more."""
        whole = sequences([plain_words(t) for t in texts])
        by_text: dict[int, list[int]] = {}
        for text, item in sorted(self.candidates(whole)):
            by_text.setdefault(text, []).append(item)
        out = [(text, self.ids[item], common, len(self.sets[item])) for text, item, common in self.short_matches(whole, least)]
        for text, items in by_text.items():
            own = np.unique(whole[text])
            for item in items:
                common = int(np.isin(self.sets[item], own, assume_unique=True).sum())
                if common >= least * len(self.sets[item]) - 1e-9:
                    out.append((text, self.ids[item], common, len(self.sets[item])))
        return out


def item_blocks(benchmark: DataFrame, block: int = BLOCK_ITEMS, unnamed: bool = False):
    """Indexes of all items with an id, and with `unnamed` of those without one too, a bounded block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    if not unnamed:
        items = items.where(F.col("item_id").isNotNull())
    parts = max(1, -(-items.count() // block))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield ItemIndex(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda i: (i[0] is None, i[0] or 0, i[1])))


def contaminated(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment) for each row of documents and each item that it contains.

    Containment is the share of the item's distinct five-word shingles that the whole document has. A text
    of fewer than five words has one shingle, itself; a text without words has none and neither contains nor is contained.
    Null texts count as empty; items with a null id are left out. Repeated rows and items are reported each. Empty tables
    give no rows. Only the id and text columns are read.
    """
    schema = "doc_id long, item_id long, n_common long, n_item long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = None
    for index in item_blocks(benchmark):

        def make(index=index):
            def step(rows):
                hits = index.contained(rows["text"], least)
                return {
                    "doc_id": [rows["doc_id"][t] for t, *_ in hits],
                    "item_id": [i for _, i, _, _ in hits],
                    "n_common": [c for _, _, c, _ in hits],
                    "n_item": [n for *_, n in hits],
                }

            return step

        one = map_rows(texts, ["doc_id", "text"], make, schema)
        found = one if found is None else found.unionByName(one)
    return found.withColumn("containment", F.col("n_common") / F.col("n_item"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of documents that contain no item, with all their columns. An item needs no id here."""
    for index in item_blocks(benchmark, unnamed=True):

        def make(index=index):
            def step(texts):
                hit = {t for t, *_ in index.contained(texts, least)}
                return [i not in hit for i in range(len(texts))]

            return step

        documents = documents.where(text_test(make))
    return documents
