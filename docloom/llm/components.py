"""Connected components by contraction, for link tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node that links reach.

    Each round points every node at its smallest neighbour, follows the pointer twice more, and replaces both ends of every
    edge by where they point. Minima are pre-aggregated where the rows are; edges that have become loops or repeats go.
    Chains shrink at least by half a round, stars vanish in one. Each round is a written table, so no lineage grows, and the
    tables of a round go when the next stands.
    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    left = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-edges",
    )
    mapping: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        near = jumped = materialize(point, f"{label}-point")
        for _ in range(2):
            up = near.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jumped = jumped.join(up, "to").select("node", F.col("up").alias("to"))
        point = materialize(jumped, f"{label}-jump")
        moved = left.join(point.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        moved = moved.join(point.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        rest = materialize(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), f"{label}-edges")
        if mapping is None:
            mapping, done = point.select("node", F.col("to").alias("component")), None
        else:
            step, done = point.select(F.col("node").alias("component"), F.col("to").alias("next")), mapping
            mapping = mapping.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        mapping = materialize(mapping, f"{label}-map")
        release(left, near, point, done)
        left = rest
    if mapping is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
