"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A document's set of word shingles gives SYMBOLS MinHash symbols of 16 bits. The distance is the least number of
differing symbols that a pair of the asked similarity exceeds with a probability of MISSED at most: 15 at 0.85 (3.5e-6,
16 or more of 32 symbols with 0.15 each) and 18 at 0.80 (1.2e-6). Two signatures within the distance agree, by
the pigeonhole principle, up to a few errors in at least one of the CHUNKS chunks; a chunk is looked up once for each
allowed set of places of its errors, so all pairs within the distance meet in a bucket.

Equal sets are one class from the start. A bucket is not expanded into pairs: the members of a large one are compared with its
first, and only those that are not within the distance of it, in blocks of bounded size, with blocks of all others. Each block gives a
spanning forest of the pairs within the distance, which has no more edges than members. Their connected components, the families, hold all pairs within the distance.

Links are confirmed on full sets inside families, and leave tasks as spanning forests too: first all members
with the family's smallest one, then, where a family has members that this did not link, blocks of those
with blocks of all others, across components only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import map_rows, materialize, may_be_among, release_caches, text_or_empty
from weblens.llm.components import connected_components
from weblens.llm.shingles import contract_words, minima, sequences

SYMBOLS, CHUNKS = 32, 8
#: Probability of a pair at the asked similarity to be farther apart than the distance, at most.
MISSED = 4e-6
#: Members that one comparison takes on either side, and on the wide side of a confirmation.
BLOCK, WIDE_BLOCK = 1024, 2048
#: Shingles on one side of a confirmation, on average, and half of those on the wide side.
BLOCK_SHINGLES = 1 << 20
_COLUMNS = [f"s{i}" for i in range(CHUNKS)]


def distance(percent: int) -> int:
    """Differing symbols up to which pairs are compared: more than that has a probability of MISSED at most."""
    differ = 1 - percent / 100
    tail, d = 0.0, SYMBOLS
    while d and (tail := tail + math.comb(SYMBOLS, d) * differ**d * (1 - differ) ** (SYMBOLS - d)) <= MISSED:
        d -= 1
    return d


def chunk_errors(percent: int) -> list[int]:
    """Errors allowed in each chunk, -1 for none of its keys.

    With d = whole * CHUNKS + rest, a pair with more than `whole` errors in rest + 1 chunks and more than whole - 1
    in the others differs in d + 1 symbols or more.
    """
    whole, rest = divmod(distance(percent), CHUNKS)
    return [whole if i <= rest else whole - 1 for i in range(CHUNKS)]


def _signed(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, set_id, s0..s7) of every row; four 16-bit symbols in each s."""

    def make():
        def step(rows):
            sets = [np.unique(x) for x in sequences([contract_words(t or "") for t in rows["text"]])]
            low = minima(sets, SYMBOLS, seed=8)
            symbols = ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype("<u2")
            words = symbols.view("<i8")
            return {
                "doc_id": rows["doc_id"],
                "text_hash": rows["text_hash"],
                "n": [len(s) for s in sets],
                "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                **{c: words[:, i] for i, c in enumerate(_COLUMNS)},
            }

        return step

    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")
    )
    schema = "doc_id long, text_hash long, n long, set_id binary, " + ", ".join(f"{c} long" for c in _COLUMNS)
    return map_rows(texts, ["doc_id", "text_hash", "text"], make, schema)


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vid, n, shingles) of the classes in wanted(vid, doc_id, set_id): the texts of one document for each."""

    def make():
        def step(rows):
            sets = [np.unique(x) for x in sequences([contract_words(t) for t in rows["text"]])]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == w for s, w in zip(sets, rows["set_id"], strict=True)]
            kept = [s.view(np.int64) for s, ok in zip(sets, same, strict=True) if ok]
            vids = [v for v, ok in zip(rows["vid"], same, strict=True) if ok]
            return {"vid": vids, "n": [len(s) for s in kept], "shingles": kept}

        return step

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.where(may_be_among(wanted, "doc_id")(F.col("doc_id")))
    found = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id)).select("vid", "set_id", "text")
    made = map_rows(found, ["vid", "set_id", "text"], make, "vid long, n long, shingles array<long>")
    return made.dropDuplicates(["vid"])


def _keys(classes: DataFrame, percent: int) -> DataFrame:
    """(key, vid): each chunk with each set of its places left out that its errors may take."""
    keys, lanes = [], SYMBOLS // CHUNKS
    for i, (c, errors) in enumerate(zip(_COLUMNS, chunk_errors(percent), strict=True)):
        for places in combinations(range(lanes), errors) if errors >= 0 else ():
            mask = (2**64 - 1) ^ sum(0xFFFF << (16 * lane) for lane in places)
            kind = (i << lanes) + sum(1 << lane for lane in places)
            keys.append(F.xxhash64(F.lit(kind), F.col(c).bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask))))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "vid")


def _grouped(names: list[str], group: list[str], work):
    """A function for mapInArrow over rows that are sorted by `group`: `work` gets whole groups, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held: list[pa.RecordBatch] = []
        for batch in batches:  # the last group of a batch may go on in the next one
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(names.index(c))[batch.num_rows - 1].as_py() for c in group]
            first = [held[0].column(names.index(c))[0].as_py() for c in group]
            if first == last:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            columns = [whole.column(names.index(c)).to_numpy() for c in group]
            cut = int(np.argmax(np.logical_and.reduce([c == v for c, v in zip(columns, last, strict=True)])))
            yield work(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Forest:
    """Union-find whose labels are kept flat, so that whole arrays of pairs can be tested at once."""

    def __init__(self, labels: np.ndarray):
        self.up = labels.astype(np.int64)
        self.taken: tuple[list[int], list[int]] = ([], [])

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def add(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.taken[0].append(x)
                self.taken[1].append(y)
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]


def _families(met: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(vid, family) of all classes that have another one within the distance.

    Linked sets differ in size by less than one band, so a member joins those of its own band and of the next
    one. Only members of a large band that are far from its first one are dealt into pairs of blocks.
    """
    width, most = math.log(100 / percent) * 1.001, distance(percent)
    rows = met.join(signatures.select("vid", F.floor(F.log("n") / width).cast("int").alias("own")), "vid")
    rows = rows.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    many = rows.groupBy("key", "band").agg(F.count("*").alias("members")).where("members > 1")
    rows = rows.join(many, ["key", "band"]).join(signatures, "vid")
    large = materialize(_stars(rows.where(F.col("members") > BLOCK), percent, most), "bucket-stars")
    zero = F.lit(0)
    small = rows.where(F.col("members") <= BLOCK).select("key", "band", zero.alias("i"), zero.alias("j"), zero.alias("block"), "own", "vid", "n", *_COLUMNS)
    rows = small.unionByName(_dealt_buckets(large))
    group = ["key", "band", "i", "j"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "vid")
    names = rows.columns

    def near_forest(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
        vid, n, band, own, block, i, j = (col[c] for c in ("vid", "n", "band", "own", "block", "i", "j"))
        symbols = np.ascontiguousarray(np.stack([col[c] for c in _COLUMNS], axis=1)).view(np.uint16)
        change = np.flatnonzero(np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in group])) + 1
        bounds = np.concatenate([[0], change, [len(vid)]])
        ends = np.repeat(bounds[1:], np.diff(bounds))
        forest, at, step = _Forest(np.arange(len(vid))), np.arange(len(vid)), 1
        while len(at := at[at + step < ends[at]]):
            other = at + step
            ok = (forest.up[at] != forest.up[other]) & ((i[at] == j[at]) | (block[at] != block[other]))
            ok &= np.maximum(own[at], own[other]) == band[at]
            ok &= np.minimum(n[at], n[other]) * 100 >= np.maximum(n[at], n[other]) * percent
            x, y = at[ok], other[ok]
            if len(x):
                near = (symbols[x] != symbols[y]).sum(axis=1) <= most
                if near.any():
                    forest.add(x[near], y[near])
            step += 1
        return _edges(vid[forest.taken[0]].tolist(), vid[forest.taken[1]].tolist())

    edges = rows.mapInArrow(_grouped(names, group, near_forest), "a long, b long")
    edges = edges.unionByName(large.where("near and vid <> first").select(F.col("vid").alias("a"), F.col("first").alias("b")))
    return connected_components(edges).select(F.col("id").alias("vid"), F.col("component").alias("family"))


def _differing(a: list[Column], b: list[Column]) -> Column:
    """Symbols that differ between two signatures: 16-bit lanes whose exclusive or is not zero."""
    counts = []
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        for shift, mask in ((8, 0x00FF), (4, 0x000F), (2, 0x0003), (1, 0x0001)):  # any bit of a lane ends in its lowest one
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(mask * 0x0001000100010001))
        counts.append(F.bit_count(d))
    return sum(counts[1:], counts[0])


def _stars(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """rows of large buckets with the bucket's first member, and whether that is within the distance."""
    firsts = rows.groupBy("key", "band").agg(F.min(F.struct("vid", "n", "own", *_COLUMNS)).alias("f"))
    both = rows.join(firsts, ["key", "band"])
    n, other = F.col("n"), F.col("f.n")
    near = F.greatest("own", "f.own") == F.col("band")
    near &= F.least(n, other) * 100 >= F.greatest(n, other) * percent
    near &= _differing([F.col(c) for c in _COLUMNS], [F.col(f"f.{c}") for c in _COLUMNS]) <= most
    near |= F.col("vid") == F.col("f.vid")
    return both.select("key", "band", "own", "vid", "n", *_COLUMNS, F.col("f.vid").alias("first"), near.alias("near"))


def _dealt_buckets(large: DataFrame) -> DataFrame:
    """Rows of large buckets as blocks of members that are not near the first one, each with blocks of all members.

    A bucket whose members are all near its first one has none. i is negative, so only members of different `block` are compared.
    """
    sizes = large.groupBy("key", "band").agg(F.count("*").alias("members"), F.sum((~F.col("near")).cast("int")).alias("apart"))
    sizes = sizes.where("apart > 0").select(
        "key", "band", F.ceil(F.col("apart") / BLOCK).cast("int").alias("p"), F.ceil(F.col("members") / WIDE_BLOCK).cast("int").alias("q")
    )
    turn = F.xxhash64("vid")
    own_p, own_q = (F.pmod(turn, F.col(k)).cast("int") for k in "pq")
    wide = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: F.struct((-1 - k).alias("i"), own_q.alias("j"), F.lit(0).alias("block")))
    apart = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: F.struct((-1 - own_p).alias("i"), k.alias("j"), F.lit(1).alias("block")))
    to = F.explode(F.when(F.col("near"), wide).otherwise(F.concat(wide, apart))).alias("to")
    rows = large.join(sizes, ["key", "band"]).select("key", "band", "own", "vid", "n", *_COLUMNS, to)
    return rows.select("key", "band", "to.i", "to.j", "to.block", "own", "vid", "n", *_COLUMNS)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that span the links of sets(vid, n, shingles, family)."""
    first = sets.where("vid = family").select(
        "family", F.col("n").alias("n_first"), F.col("shingles").alias("of_first")
    )
    both = sets.where("vid <> family").join(first, "family")
    common = F.size(F.array_intersect("shingles", "of_first"))
    both = both.select("vid", "family", "n", "n_first", common.alias("common"))
    union = F.col("n") + F.col("n_first") - F.col("common")
    stars = materialize(both.select("vid", "family", "n", (F.col("common") * 100 >= union * percent).alias("linked")), "stars")
    # Members that their family's first one is not linked with, in blocks, with blocks of all its members.
    apart = stars.where("not linked").select("vid", F.lit(True).alias("apart"))
    left = (~F.col("linked")).cast("int")

    def blocks(count, shingles, most: int, most_shingles: int):
        return F.ceil(F.greatest(count / most, shingles / most_shingles)).cast("int")

    sizes = stars.groupBy("family").agg(
        blocks(F.sum(left), F.sum(left * F.col("n")), BLOCK, BLOCK_SHINGLES).alias("p_blocks"),
        blocks(F.count("*") + 1, F.sum("n"), WIDE_BLOCK, 2 * BLOCK_SHINGLES).alias("q_blocks"),
    )
    rows = sets.join(sizes.where("p_blocks > 0"), "family").join(apart, "vid", "left")
    rows = rows.withColumn("apart", F.coalesce("apart", F.lit(False)))
    turn = F.xxhash64("vid")
    p, q = (F.pmod(turn, F.col(f"{k}_blocks")).cast("int") for k in "pq")
    some = F.transform(F.sequence(F.lit(0), F.col("p_blocks") - 1), lambda k: F.struct(k.alias("p"), q.alias("q"), F.lit(0).alias("side")))
    other = F.transform(F.sequence(F.lit(0), F.col("q_blocks") - 1), lambda k: F.struct(p.alias("p"), k.alias("q"), F.lit(1).alias("side")))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("apart"), F.concat(some, other)).otherwise(some)))
    dealt = dealt.select("family", "to.p", "to.q", "to.side", "vid", "n", "apart", "shingles")
    group = ["family", "p", "q"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "side", "n", "vid")
    names = dealt.columns

    def link_forest(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        col = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names) if c != "shingles"}
        lists = batch.column(names.index("shingles"))
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        change = np.flatnonzero(np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in group])) + 1
        bounds = np.concatenate([[0], change, [batch.num_rows]])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            base = offsets[lo]
            _, ids = np.unique(flat[base : offsets[hi]], return_inverse=True)
            cut = offsets[lo : hi + 1] - base
            n, vid, apart = col["n"][lo:hi], col["vid"][lo:hi], col["apart"][lo:hi]
            middle = int(np.searchsorted(col["side"][lo:hi], 1))  # wide side first, then the members to test
            # The members that the first one is linked with are one component already.
            linked = np.flatnonzero(~apart[:middle])
            labels = np.arange(hi - lo)
            labels[linked] = linked[0] if len(linked) else 0
            places = {int(v): k for k, v in enumerate(vid[:middle])}
            for k in range(middle, hi - lo):  # a member that is on both sides
                labels[k] = places.get(int(vid[k]), k)
            forest = _Forest(labels)
            marked = np.zeros(len(ids), dtype=bool)
            for x in range(middle, hi - lo):
                y0 = int(np.searchsorted(n[:middle] * 100, n[x] * percent, side="left"))
                y1 = int(np.searchsorted(n[:middle] * percent, n[x] * 100, side="right"))
                if y0 >= y1 or not (forest.up[y0:y1] != forest.up[x]).any():
                    continue
                own = ids[cut[x] : cut[x + 1]]
                marked[own] = True
                common = np.add.reduceat(marked[ids[cut[y0] : cut[y1]]], cut[y0:y1] - cut[y0], dtype=np.int64)
                marked[own] = False
                ok = (common * 100 >= (n[x] + n[y0:y1] - common) * percent) & (forest.up[y0:y1] != forest.up[x])
                if ok.any():
                    ys = np.flatnonzero(ok) + y0
                    forest.add(np.full(len(ys), x), ys)
            a += vid[forest.taken[0]].tolist()
            b += vid[forest.taken[1]].tolist()
        return _edges(a, b)

    more = dealt.mapInArrow(_grouped(names, group, link_forest), "a long, b long")
    return stars.where("linked").select(F.col("vid").alias("a"), F.col("family").alias("b")).unionByName(more)


def near_components(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept, text_hash.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their shingle sets. A text without
    words has an empty set and is linked with nothing: its component is its own id. component_id is the
    smallest doc_id that can be reached; null ids take part in links but are no one's smallest id, and a component of null ids
    only has a null component_id and is kept. Where an id repeats, its rows are linked by their texts only.
    An empty table gives no rows. Only doc_id and text are read.
    """
    signed = materialize(_signed(documents), "signed")
    full = signed.where("n > 0")
    first = full.groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in _COLUMNS)
    )
    classes = materialize(first.withColumn("vid", F.monotonically_increasing_id()), "classes")
    components = _linked(documents, classes, percent)
    named = classes.select("set_id", "vid", "doc_id").join(components.withColumnRenamed("id", "vid"), "vid", "left")
    named = named.select("set_id", "doc_id", F.coalesce("component", "vid").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(smallest, "component").select("set_id", "component_id"), "named-sets")
    linked = full.select("doc_id", "text_hash", "n", "set_id").join(named, "set_id").drop("set_id")
    alone = signed.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_hash",
    )


def one_of_each(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of documents that near_components keeps, with all their columns; of rows that agree in id and text, one.

    Most texts stay where they are: only those that a filter of fixed size takes for dropped ones are shuffled
    to be joined.
    """
    rows = materialize(near_components(documents, percent).select("doc_id", "text_hash", "kept"), "kept")
    again = rows.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1")
    gone = materialize(
        rows.where("not kept").select("doc_id", "text_hash", F.lit(False).alias("again")).distinct().unionByName(
            again.select("doc_id", "text_hash", F.lit(True).alias("again"))
        ),
        "dropped",
    )
    if gone.isEmpty():
        return documents
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    # The row as one value: its columns' names cannot meet those used here.
    held = documents.select(
        F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash")
    )
    maybe = may_be_among(gone.select(key.alias("k")), "k")(key)
    sure, asked = held.where(~maybe), held.where(maybe)
    g = gone.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "again")
    found = asked.join(g, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    once = found.where("again").dropDuplicates(["doc_id", "text_hash"])
    kept = sure.select("whole").unionByName(found.where("again is null").select("whole")).unionByName(once.select("whole"))
    return kept.select("whole.*")


def _linked(documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes that have a link."""
    signatures = classes.select("vid", "n", *_COLUMNS)
    keys = _keys(classes, percent)
    buckets = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    families = materialize(_families(keys.join(buckets, "key"), signatures, percent), "families")
    wanted = families.join(classes.select("vid", "doc_id", "set_id"), "vid")
    sets = materialize(_sets(documents, wanted.select("vid", "doc_id", "set_id")).join(families, "vid"), "sets")
    return connected_components(_links(sets, percent))
