"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b): the smallest node reachable.

    Each round every remaining node takes the smallest of its neighbours and itself as parent,
    chains of parents are shortened until all point to their end, and links are renamed to
    these ends. At least half of the nodes with a link vanish per round, also in long chains.
    Links become fewer, and a node with very many links is a partial minimum per task.
    """
    both = links.select("a", "b").filter("a <> b")
    edges = materialize(
        both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    found = None
    while edges.limit(1).count():
        parent = materialize(
            edges.groupBy(F.col("a").alias("node"))
            .agg(F.least(F.min("b"), F.first("a")).alias("root")),
            "parents",
        )
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            shorter = materialize(
                parent.join(above, "root", "left")
                .select("node", F.coalesce("next", "root").alias("new"), "root"),
                "parents",
            )
            moved = shorter.filter("new <> root").limit(1).count()
            parent = shorter.select("node", F.col("new").alias("root"))
            if not moved:
                break
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = materialize(
                found.join(up, "root", "left")
                .select("node", F.coalesce("next", "root").alias("root")),
                "components",
            )
        ends = parent.select(F.col("node").alias("a"), F.col("root").alias("x"))
        half = edges.join(ends, "a").select("x", F.col("b").alias("a"))
        edges = materialize(
            half.join(ends.withColumnRenamed("x", "y"), "a")
            .filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            "links",
        )
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return found
