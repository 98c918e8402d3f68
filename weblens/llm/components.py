"""Connected components of a link table, by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of links(a, b); component is the smallest id that can be reached.

    Each round hooks every root to its smallest smaller neighbour, flattens the resulting trees by
    pointer jumping, and contracts the links to roots; at least half of the roots that still have links
    go in each round. Rounds end when no link joins two roots.
    """
    links = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = ends.withColumn("component", F.col("id"))
    while not links.isEmpty():
        parents = materialize(links.groupBy("a").agg(F.min("b").alias("b")).withColumnsRenamed({"a": "id", "b": "up"}), "up")
        while True:
            above = parents.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = materialize(
                parents.join(above, "up", "left").select(
                    "id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")
                ),
                "jump",
            )
            parents = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        root = parents.select(F.col("id").alias("component"), "up")
        whole = materialize(
            whole.join(root, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "components"
        )
        of_a, of_b = (parents.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b"))
        moved = links.join(of_a, "a", "left").join(of_b, "b", "left")
        moved = moved.select(F.coalesce("up_a", "a").alias("x"), F.coalesce("up_b", "b").alias("y")).where("x <> y")
        links = materialize(
            moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links"
        )
    return whole
