"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations and joins on the edges; labels, edges and nodes
never leave the executors.  Edges of a node with very many of them are joined
to its least neighbour where they are, those of all other nodes by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, named, save


def _star(edges: DataFrame, both: bool, total: int) -> DataFrame:
    """edges (u > v), no more than total -> edges to the least node of each neighbourhood."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
    near = named(near, least, "u", 2 * total)
    if both:  # larger neighbours move to the least node
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours, and the node itself, move to the least node
        out = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge to another node.

    component is the least node reachable.  Loops and repeated edges do no
    harm; edges with a null end are left out; no edges give no rows.
    """
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null").filter("u > v").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if found[0] == 0 or found == mark:
            break
        mark = found
        large = save(_star(now, True, found[0]), "edges")
        drop(now)
        now = save(_star(large, False, found[0]), "edges")
        drop(large)
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
