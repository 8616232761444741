"""Connected components of an undirected edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import durable


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0))).first()
    return row[0], row[1]


def _contract(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest node near it, then the rest."""
    # larger neighbours of u hang on the least node of u's closed neighbourhood
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    large = (
        both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
    )
    # smaller neighbours of u, and u itself, hang on the least of them
    down = large.groupBy("src").agg(F.min("dst").alias("m"))
    small = large.join(down, "src")
    return (
        small.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        .where("src <> dst")
        .unionByName(down.select("src", F.col("m").alias("dst")))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(src, dst)`` longs -> one row ``(node, component)`` per node that has an edge to another node.

    ``component`` is the smallest node reachable. Self loops and null ends are ignored, repeated
    edges do no harm; an empty list gives no rows. A node of very high degree is a hot join key
    whose rows AQE splits; nothing is collected but two numbers a round. Rounds grow with the
    logarithm of the longest path.
    """
    e = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    e = durable(e)
    seen = _signature(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        e = durable(_contract(e))
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    node = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return node.unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
