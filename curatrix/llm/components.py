"""Connected components of an edge table by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of edges (a long, b long): the same root for connected vertices.

    Each round every vertex hooks to its neighbour of least hashed rank if that is below its own, pointers are
    followed one step further, and edges are rewritten between the targets; loops and repeats go. The graph
    shrinks by a constant factor a round, so the rounds are few. Each round's pointers are written out; labels
    are resolved from the last round back to the first. All steps are aggregations that combine before the
    shuffle or joins against one row per vertex.
    """
    edges = edges.where("a != b").select("a", "b")
    steps = []
    number = 0
    while True:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("r"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        hook = near.select("u", F.least(rank("u"), F.col("near"))["v"].alias("p"))
        hook = save(hook, "cc-hook")
        if hook.isEmpty():
            break
        step = save(hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p")
                    .select("u", F.col("pp").alias("p")), "cc-step")
        steps.append(step)
        edges = save(edges.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
                     .join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
                     .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                     .distinct(), "cc-edges")
        number += 1
    if not steps:
        return edges.select(F.col("a").alias("u"), F.col("b").alias("root"))
    labels = steps[-1].select("u", F.col("p").alias("root"))
    for step in reversed(steps[:-1]):
        above = labels.select(F.col("u").alias("p"), "root")
        labels = step.join(above, "p", "left").select("u", F.coalesce("root", "p").alias("root"))
    return labels
