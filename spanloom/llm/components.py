"""Connected components by joins: nodes hook to their least neighbour, and what has become one node is contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import stored


def kept(rows: DataFrame) -> DataFrame:
    return stored(rows, "components")


def components(links: DataFrame) -> DataFrame:
    """id, label (the least id of its component) of every end of a link (a, b).

    In a round every node takes the least node around it, if lower, and then, doubling the
    way each time, what that one took, to the end.  Links between nodes of one label are
    gone then and the others join labels, so their number falls quickly: a star is done in
    one round, and any component at least halves.

    What a step leaves is stored as columns: a checkpoint of rows computes them twice and
    keeps one file and one later task for every shuffle partition, however few the links.
    """
    edges = kept(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropDuplicates())
    found = None
    while found is None or edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("label"), F.least("a", "b").alias("lower"))
        step, changed = kept(step), True
        while changed:
            further = step.select(F.col("label").alias("lower"), F.col("lower").alias("least"))
            jumped = kept(step.join(further, "lower").select("label", F.col("lower").alias("was"),
                                                             F.col("least").alias("lower")))
            changed = jumped.where("lower <> was").limit(1).count() > 0
            step = jumped.select("label", "lower")
        if found is None:
            found = step.select(F.col("label").alias("id"), F.col("lower").alias("label"))
        else:
            found = kept(found.join(step, "label", "left").select("id", F.coalesce("lower", "label").alias("label")))
        low, high = (step.select(F.col("label").alias(e), F.col("lower").alias(f"{e}_")) for e in "ab")
        edges = kept(edges.join(low, "a").join(high, "b").where("a_ <> b_").select(
            F.greatest("a_", "b_").alias("a"), F.least("a_", "b_").alias("b")).dropDuplicates())
    return found
