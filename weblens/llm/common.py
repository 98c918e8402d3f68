"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words, everywhere in this package.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for the rows that no model learns from; a null id counts as its empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 3) == 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and Spark runs on this machine alone, as in tests, a folder of
    this machine is set; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "weblens-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weblens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled_ids(labels: DataFrame, key: str, limit: int) -> list[int]:
    """At most `limit` ids in the order of a hash of the id: the same rows for the same table."""
    rows = (
        labels.select(F.col(key).alias("k"))
        .where(F.col("k").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("k"), "k")
        .limit(limit)
        .collect()
    )
    return [r[0] for r in rows]


def training_texts(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> list[tuple[str, int]]:
    """Whole texts and labels of at most `limit` rows outside the held-out fold.

    Ids are chosen from the narrow label table first, so texts of other rows never leave their scan.
    Only `limit` ids are sent out with the filter.
    """
    usable = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where(
        F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k")
    )
    picked = (
        usable.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(limit).collect()
    )
    of = {r["k"]: r["y"] for r in picked}
    if not of:
        return []
    rows = documents.select(F.col("doc_id").alias("k"), text_or_empty().alias("t")).where(F.col("k").isin(list(of)))
    return [(r["t"], of[r["k"]]) for r in sorted(rows.collect(), key=lambda r: (r["k"], r["t"]))]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Caches of this Python worker: owner -> what empties it.
_CACHES: dict[str, Callable[[], None]] = {}


def keep_cache(owner: str, clear: Callable[[], None]) -> None:
    """Tell that `owner` keeps something between the tasks of a Python worker."""
    _CACHES[owner] = clear


def release_caches(*owners: str) -> None:
    """Empty the caches of all but `owners`: a worker serves the tasks of many stages, one after the other.

    Memory that was given back goes to the system, so that a worker doesn't keep the most that any of its tasks took.
    """
    for other in [o for o in _CACHES if o not in owners]:
        _CACHES.pop(other)()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
    text: str = "text",
    most_chars: int = 3_000_000,
    most_rows: int = 2048,
) -> DataFrame:
    """Run a batch function over `columns` of df, with bounded memory.

    `make` runs once in each task and returns the batch function. A batch holds at most `most_chars`
    characters unless one text alone is longer, so very long texts do not pile up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(spark_schema(df.sparkSession, schema))
    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches(owner)
        step = make()
        for batch in batches:
            for part in slices(batch, columns.index(text), most_chars, most_rows):
                yield _step(step, part, columns, out)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 3_000_000, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most_bytes` of text in `column`, unless one text alone is longer."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def _step(step, batch: pa.RecordBatch, columns: list[str], out: pa.Schema) -> pa.RecordBatch:
    made = step({c: batch.column(i).to_pylist() for i, c in enumerate(columns)})
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)


def spark_schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def text_test(make: Callable[[], Callable[[list[str]], list[bool]]], most_chars: int = 3_000_000) -> Column:
    """A boolean column over the text column; nulls count as empty. `make` runs once in each task."""
    from pyspark.sql.functions import pandas_udf

    owner = make.__module__

    @pandas_udf("boolean")
    def test(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_caches(owner)
        step = make()
        for part in parts:
            texts, out, start, chars = list(part), [], 0, 0
            for i, text in enumerate(texts):
                if i > start and chars + len(text) > most_chars:
                    out += step(texts[start:i])
                    start, chars = i, 0
                chars += len(text)
            yield pd.Series([*out, *(step(texts[start:]) if start < len(texts) else [])], dtype="boolean")

    return test(text_or_empty())


#: Bits of the filter of may_be_among, which bounds what it sends to the tasks at 1 MB.
FILTER_BITS = 1 << 23


def may_be_among(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every id in ids.column, and for few others while those are some millions at most.

    It is a Bloom filter of fixed size with two hashes, and keeps rows that a join will drop from being shuffled.
    """
    from pyspark.sql.functions import pandas_udf

    places = ids.select(
        F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(FILTER_BITS)) for k in (1, 2)))).alias("p")
    )
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(p % 64 as int))")).alias("bits")
    )
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    rows = words.toPandas()
    table[rows["w"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)

    @pandas_udf("boolean")
    def test(first: pd.Series, second: pd.Series) -> pd.Series:
        a, b = first.to_numpy(dtype=np.int64), second.to_numpy(dtype=np.int64)
        return pd.Series(((table[a >> 6] >> (a & 63)) & (table[b >> 6] >> (b & 63)) & 1).astype(bool))

    return lambda c: test(*(F.pmod(F.xxhash64(F.lit(k), c), F.lit(FILTER_BITS)) for k in (1, 2)))
