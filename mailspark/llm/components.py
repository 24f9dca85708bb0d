"""Connected components of a graph given as an edge table."""

from pyspark.sql import functions as F

from mailspark.session import written


def _low(edges):
    """Least neighbour of each node, itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def components(edges, most_rounds=60):
    """(node, label) for each node of ``edges`` (u, v: bigint, any direction,
    u <> v); the label is the least node that can be reached.

    Alternating large-star and small-star rounds: each round links the larger,
    then the smaller neighbours of a node to its least neighbour, which ends
    in stars around the least nodes after O(log^2 n) rounds. The least
    neighbour is a plain aggregate, pre-aggregated in the map tasks; so a hub
    costs a row per task. Each round is a table in the shared folder.
    """
    def both(e):
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = written(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(now)
    for _ in range(most_rounds):
        pairs = both(now)
        large = written(
            pairs.join(_low(pairs), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct(), "large-star")
        low = _low(large)
        small = (
            large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v")))
        )
        now = written(small.filter("u <> v").distinct(), "small-star")
        reached = state(now)
        if reached == seen:
            break
        seen = reached
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
