"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into fixed-size blocks. Equal blocks get the same integer name and different
blocks get different names; then adjacent names are paired and the pairs are named in turn, until
one name is left for each document. Two documents have the same (levels, name) exactly when their
texts are equal, so this identity has no collisions.

Blocks are sorted by (hash, content). The hash only places a block: wherever two hashes agree, the
contents are compared. Copies are removed before the shuffle, and block content crosses the network
once. Every join that carries names back to documents is an equi-join between two shuffled inputs,
whose hot keys Spark splits at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblens.llm.common import materialize, text_or_empty

#: Characters in a block. Most texts are one block, so few rows enter the pairing levels.
BLOCK_CHARS = 4096


def _cut(block_chars: int) -> Column:
    return F.when(F.length("text") <= block_chars, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )


def block_names(blocks: DataFrame, hash_of: Column) -> DataFrame:
    """(row columns of blocks without content) and the integer `name` of each block's content."""
    keyed = blocks.withColumn("h", hash_of)
    variants = keyed.select("h", "block").distinct().groupBy("h").agg(F.count("*").cast("int").alias("variants"))
    names = materialize(
        variants.select("h", "variants", F.explode(F.sequence(F.lit(0), F.col("variants") - 1)).alias("variant"))
        .sortWithinPartitions("h", "variant")
        .withColumn("name", F.monotonically_increasing_id()),
        "block-names",
    )
    shared = names.where(F.col("variants") > 1)
    if shared.isEmpty():
        return keyed.drop("block").join(names.select("h", "name"), "h").drop("h")
    # Different contents under one hash: these few are ranked by content.
    order = Window.partitionBy("h").orderBy("block")
    ranked = (
        keyed.join(shared.select("h").distinct(), "h", "left_semi")
        .select("h", "block")
        .distinct()
        .withColumn("variant", F.row_number().over(order) - 1)
    )
    return (
        keyed.join(ranked, ["h", "block"], "left")
        .withColumn("variant", F.coalesce("variant", F.lit(0)))
        .drop("block")
        .join(names.select("h", "variant", "name"), ["h", "variant"])
        .drop("h", "variant")
    )


def pair_names(rows: DataFrame) -> DataFrame:
    """One level: adjacent names of a document are paired, and equal pairs get one new name."""
    paired = rows.groupBy("doc_id", "text_sha256", "n", F.expr("idx div 2").alias("idx")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    paired = materialize(paired, "pairs")
    names = materialize(
        paired.select("left", "right")
        .distinct()
        .sortWithinPartitions("left", "right")
        .withColumn("name", F.monotonically_increasing_id()),
        "pair-names",
    )
    return paired.join(names, ["left", "right"]).select(
        "doc_id", "text_sha256", F.expr("(n + 1) div 2").alias("n"), "idx", "name"
    )


def exact_groups(documents: DataFrame, block_chars: int = BLOCK_CHARS, hash_of: Column | None = None) -> DataFrame:
    """One row for each row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same string; a null text counts as the empty text. The row with
    the largest doc_id of a group stays; null ids sort below all others. Where an id repeats within a
    group, each of its rows is returned and all of them are marked alike. An empty table gives no
    rows. Only doc_id and text are read, so other columns can have any name.
    """
    hash_of = F.xxhash64("block") if hash_of is None else hash_of
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    blocks = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), _cut(block_chars).alias("blocks"))
    blocks = blocks.select(
        "doc_id", "text_sha256", F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("idx", "block")
    ).withColumn("idx", F.col("idx").cast("long"))
    first = materialize(block_names(blocks, hash_of), "named")
    done = first.where("n = 1").select("doc_id", "text_sha256", F.lit(0).alias("level"), "name")
    current = first.where("n > 1").select("doc_id", "text_sha256", "n", "idx", "name")
    level = 0
    while not current.isEmpty():
        level += 1
        current = materialize(pair_names(current), "level")
        ended = current.where("n = 1").select("doc_id", "text_sha256", F.lit(level).alias("level"), "name")
        rows = first.where("n > 1 and idx = 0").select("doc_id", "text_sha256")
        done = done.unionByName(
            rows.alias("r")
            .join(
                ended.alias("e"),
                F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.text_sha256") == F.col("e.text_sha256")),
            )
            .select("r.doc_id", "r.text_sha256", "level", "name")
        )
        current = current.where("n > 1")
    done = materialize(done, "identities") if level else done
    groups = materialize(
        done.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    return done.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
