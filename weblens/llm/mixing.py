"""Mixing sources to target weights by index, without moving text.

The words of each source, its documents in a pseudorandom order, are packed into blocks of fixed length. Every source
has a quota of output slots that meets its target. The slots of each output shard are drawn over the
sources by a multinomial conditioned on the quotas (a multivariate hypergeometric draw); the draws are split along a
binary tree over the shards, so that each shard works out its own counts and the slots before it alone. The k-th
slot of a source is block p(k mod blocks), p being the source's pseudorandom permutation for that pass
over its blocks; then slots and blocks are joined by (source, block).

One row for each source comes to the driver and goes to all tasks; documents, blocks and slots don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.llm.common import materialize, text_or_empty

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 3
#: A source is repeated so many times at most.
MOST_PASSES = 3
#: Documents that are ordered in one task.
ORDERED = 10_000
#: Sources up to which their table is sent to all tasks in a broadcast join.
BROADCAST_SOURCES = 100_000
#: Parts of a source whose sizes are added up in one task.
ADDED = 1024
#: numpy's limit of a hypergeometric draw. Larger draws are made here, from the same distribution.
_NUMPY_TOTAL = 900_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST_PASSES) -> list[float]:
    """Shares of the sum of sizes by weight; what a source cannot take is shared again by weight."""
    out = [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in over]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rounds(n: int, key: tuple[int, ...]) -> tuple[np.uint64, np.uint64, np.ndarray]:
    """(bits of a half, their mask, round keys) of the Feistel network over range(n)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    keys = np.random.default_rng([SEED, *key]).integers(0, 2**64, size=4, dtype=np.uint64)
    return np.uint64(half), np.uint64((1 << half) - 1), keys


def permute(index: np.ndarray, n: int, key: tuple[int, ...], back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of range(n), or its inverse: a Feistel network over an even number of bits, walked into range."""
    half, mask, keys = _rounds(n, key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + k) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass
class MixPlan:
    """Per source, in the order of sid: words, target, blocks, and the quota of slots."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    quotas: list[int]
    block_words: int
    shard_slots: int

    @property
    def shards(self) -> int:
        return -(-sum(self.quotas) // self.shard_slots)

    def block_of(self, sid: int, slots: np.ndarray) -> np.ndarray:
        n = self.blocks[sid]
        out = np.empty(len(slots), dtype=np.int64)
        passes = slots // n
        for p in np.unique(passes):
            own = passes == p
            out[own] = permute(slots[own] % n, n, (sid, int(p)))
        return out

    def taken(self, sid: int, quota: int) -> int:
        """Words in the first `quota` slots: whole blocks, but for the last block of the source."""
        n = self.blocks[sid]
        whole, rest = divmod(quota, n)
        last = int(permute(np.array([n - 1]), n, (sid, whole), back=True)[0] < rest) if rest else 0
        short = n * self.block_words - self.sizes[sid]
        return quota * self.block_words - short * (whole + last)

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots of each source in shard k, slots of each source in all shards before it)."""
        counts, before = np.array(self.quotas, dtype=np.int64), np.zeros(len(self.quotas), dtype=np.int64)
        lo, hi = 0, self.shards
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = _draw(counts, (mid - lo) * self.shard_slots, np.random.default_rng([SEED, 77, lo, hi]))
            if k < mid:
                counts, hi = left, mid
            else:
                before, counts, lo = before + left, counts - left, mid
        return counts, before


def _draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n slots fall to each source, of which counts are left: a multivariate hypergeometric draw."""
    left = [int(c) for c in counts]
    total = sum(left)
    n = min(n, total)
    if total < _NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros(len(left), dtype=np.int64)
    for i, good in enumerate(left):
        total -= good
        out[i] = hypergeometric(good, total, n, rng)
        n -= int(out[i])
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Good ones among n of good + bad, for totals of any size: rejection from a table mountain (ratio of uniforms).

    The probabilities of two counts are compared by differences from the likeliest count, so large totals lose no precision.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if good + bad < _NUMPY_TOTAL:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    mean = n * good / total
    spread = (mean * (bad / total) * ((total - n) / (total - 1)) + 0.5) ** 0.5
    wide = 2 * (2 / math.e) ** 0.5 * spread + 3 - 2 * (3 / math.e) ** 0.5

    def relative(k: int) -> float:
        """log p(k) - log p(mode)."""
        d = k - mode
        # log of C(good, k) * C(bad, n - k): each factorial's change, and what is linear in d of all four together.
        above, below = (good - mode + 1) * (n - mode + 1), (mode + 1) * (bad - n + mode + 1)
        linear = d * math.log1p((above - below) / below)
        return linear - sum(_bend(x + 1, s * d) for x, s in ((mode, 1), (good - mode, -1), (n - mode, -1), (bad - n + mode, 1)))

    while True:
        u, v = rng.random(2).tolist()
        if u == 0.0:
            continue
        k = math.floor(mean + 0.5 + wide * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= relative(k):
            return k


def _bend(x: int, d: int) -> float:
    """log((x + d - 1)! / (x - 1)!) - d * log(x), for x of 1 or more."""
    if d == 0:
        return 0.0
    if x + min(d, 0) < 1000:  # few factors or small ones: exact enough by the library
        return math.lgamma(x + d) - math.lgamma(x) - d * math.log(x)
    series = (1 / (x + d) - 1 / x) / 12
    return (x + d - 0.5) * math.log1p(d / x) - d + series


def make_plan(sources: list[tuple[str | None, int]], block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> MixPlan:
    """Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3 and so on."""
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [n for _, n in sources]
    aims = targets(sizes, [1 + i % 3 for i in range(len(sizes))])
    blocks = [-(-n // block_words) for n in sizes]
    plan = MixPlan([s for s, _ in sources], sizes, aims, blocks, [0] * len(sizes), block_words, shard_slots)
    for sid, (size, aim, n) in enumerate(zip(sizes, aims, blocks, strict=True)):
        if size:
            near = round(aim * n / size)
            tries = [q for q in (near, near - 1, near + 1) if 0 <= q <= MOST_PASSES * n]
            # Which quota comes nearest depends on how often the source's short last block is among its slots.
            plan.quotas[sid] = min(tries, key=lambda q: abs(plan.taken(sid, q) - aim))
    return plan


def _placed(documents: DataFrame, extra: dict[str, Column]) -> tuple[DataFrame, MixPlan]:
    """(doc_id, source, size, sid, start, extra columns) of every row, start being its first word's place in its source."""
    spark = documents.sparkSession
    sized = materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text_or_empty()).alias("size"),
            *(c.alias(name) for name, c in extra.items()),
        ),
        "mix-sizes",
    )
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    plan = make_plan([(r["source"], r["size"]) for r in stats])
    rows_of = {r["source"]: r["rows"] for r in stats}
    table = spark.createDataFrame(
        [
            (sid, s, plan.sizes[sid], plan.targets[sid], -(-rows_of[s] // ORDERED))
            for sid, s in enumerate(plan.sources)
        ],
        "sid int, its string, source_size long, target double, parts long",
    )
    table = F.broadcast(table) if len(plan.sources) <= BROADCAST_SOURCES else table
    known = sized.join(table, sized.source.eqNullSafe(F.col("its")), "left").drop("its")
    mixed = F.xxhash64(F.lit(SEED), "doc_id")
    known = known.withColumn("turn", mixed).withColumn("part", F.pmod("turn", F.col("parts")))
    parts = known.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("run", F.expr(f"part div {ADDED}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy("sid", "run").agg(F.sum("words").alias("words"))
    runs = runs.select(
        F.col("sid").alias("sid_of"), F.col("run").alias("run_of"),
        F.coalesce(F.sum("words").over(before.partitionBy("sid").orderBy("run")), F.lit(0)).alias("first"),
    )
    inside = F.coalesce(F.sum("words").over(before.partitionBy("sid", "run").orderBy("part")), F.lit(0))
    parts = parts.withColumn("inside", inside).join(runs, (F.col("sid") == F.col("sid_of")) & (F.col("run") == F.col("run_of")))
    parts = parts.select(F.col("sid").alias("of"), F.col("part").alias("at"), (F.col("first") + F.col("inside")).alias("base"))
    within = Window.partitionBy("sid", "part").orderBy("turn", "doc_id", "size", *extra).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = known.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(parts, (placed.sid == parts["of"]) & (placed.part == parts["at"]))
    placed = placed.withColumn("start", F.col("base") + F.col("inner"))
    return materialize(placed.drop("of", "at", "base", "inner", "turn", "part", "parts"), "mix-placed"), plan


def _slots(documents: DataFrame, plan: MixPlan) -> DataFrame:
    """(shard, sid, block): the content of every output slot."""
    spark = documents.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                counts, before = plan.shard(k)
                for sid in np.flatnonzero(counts).tolist():
                    blocks = plan.block_of(sid, np.arange(before[sid], before[sid] + counts[sid]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(blocks), v)) for v in (k, np.int32(sid))] + [pa.array(blocks)],
                        names=["shard", "sid", "block"],
                    )

    return spark.range(plan.shards).mapInArrow(run, "shard long, sid int, block long")


def _pieces(placed: DataFrame, plan: MixPlan) -> DataFrame:
    """(sid, start, block, words, times): the parts of documents that the mix takes, and how often."""
    size = plan.block_words
    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").select(
        "sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + size - 1) div {size}"))).alias("block")
    )
    parts = parts.withColumn(
        "words", F.least(end, (F.col("block") + 1) * size) - F.greatest(F.col("start"), F.col("block") * size)
    )
    slots = _slots(placed, plan).groupBy("sid", "block").agg(F.count("*").alias("times"))
    # The plan takes the slots for small, because it sees the shard numbers that they are made from.
    joined = parts.hint("merge").join(slots.hint("merge"), ["sid", "block"])
    return joined.select("sid", "start", "block", "words", "times")


def mix(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, source, size, source_size, target, taken.

    size counts words, and a null or empty text has none and is never taken. taken has the words that the mix takes from the row,
    repeats counted: at most three times its size. A null source is a source of its own. Order within a source
    is by a hash of doc_id, so results don't depend on partitions; repeated rows lie side by side. An empty table
    gives no rows. Only doc_id, source and text are read.
    """
    placed, plan = _placed(documents, {})
    taken = _pieces(placed, plan).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("words"))
    taken = taken.select(F.col("sid").alias("s"), F.col("start").alias("b"), F.col("words").alias("taken"))
    full = placed.where("size > 0").join(taken, (F.col("sid") == F.col("s")) & (F.col("start") == F.col("b")), "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return full.select(*out).unionByName(none.select(*out))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as the mix takes them, with all their columns.

    The first copy of a text has all of its words that any slot takes, in their order and with what stands between them; words that are taken
    twice or three times follow again, a new line before each run. n_chars, where there is such a column,
    follows the new text. Rows of which nothing is taken go, and so do null and empty texts. Rows that agree in all columns are told apart by
    what the mix takes of them. Columns may have any names. A null source is a source of its own, and an empty table gives no rows. A very
    long text is one row, and a task holds it once or twice.
    """
    other = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    row = F.xxhash64(text_or_empty(), F.to_json(F.struct(*other))).alias("row_hash")
    text_hash = F.xxhash64(F.lit(1), text_or_empty()).alias("text_hash")
    keys = ["doc_id", "row_hash", "text_hash"]
    placed, plan = _placed(documents, {"row_hash": row, "text_hash": text_hash})
    pieces = _pieces(placed, plan).groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct("block", "words", "times"))).alias("pieces"))
    pieces = pieces.select(F.col("sid").alias("s"), F.col("start").alias("b"), "pieces")
    found = placed.where("size > 0").join(pieces, (F.col("sid") == F.col("s")) & (F.col("start") == F.col("b")))
    found = found.select(_key(*keys), "start", "pieces")
    # The row as one value: its columns' names cannot meet those used here.
    whole = documents.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), row, text_hash)
    joined = whole.select("whole", _key(*keys)).dropDuplicates(["key"]).join(found, "key")
    size = plan.block_words

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(text, start, pieces):
        import pandas as pd

        return pd.Series([_cut(t or "", s, [(p["block"], p["words"], p["times"]) for p in ps], size) for t, s, ps in zip(text, start, pieces, strict=True)])

    joined = joined.withColumn("new", cut(F.col("whole.text").cast("string"), F.col("start"), F.col("pieces")))
    new = {"text": F.col("new")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length("new").cast(documents.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in documents.columns))


def _key(*columns: str) -> Column:
    """A key without nulls."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("key")


def _cut(text: str, start: int, pieces: list[tuple[int, int, int]], size: int) -> str:
    import re

    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for copy in range(1, MOST_PASSES + 1):
        runs: list[list[int]] = []
        for block, words, times in pieces:
            if times < copy:
                continue
            first = max(block * size, start) - start
            if runs and runs[-1][1] == first:
                runs[-1][1] = first + words
            else:
                runs.append([first, first + words])
        out += [text if (a, b) == (0, len(spans)) else text[spans[a][0] : spans[b - 1][1]] for a, b in runs]
    return "\n".join(out)
