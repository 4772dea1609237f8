"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined map-side) and an ordinary equi-join whose hot keys the
adaptive planner can split; nothing is gathered per component. Rounds are written to the shared
folder, so the lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over pairs (u, v): neighbours move to the least neighbour of u."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) to rows (node, component), component being the least node reachable.

    Only nodes with an edge appear. Self-links and repeated links change nothing.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before, now = now, materialise(_star(_star(now, True), False), "edges")
        discard(before)  # the new table holds all that later rounds need
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
