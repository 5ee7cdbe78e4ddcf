"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import discard, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(`node`, `root`) for every node of `edges` (`a`, `b`; both ways mean the same); root is the least node reachable.

    Each step replaces every node's links by links to the least node it knows, so a chain shrinks
    as its logarithm. Every step is written to the shared folder. No edges give no rows.
    """
    spark = edges.sparkSession
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        # large star: the larger neighbours of a node point to the least of its neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        # small star: the smaller neighbours of a node, and itself, point to the least of them
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("_m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least)
        before, now = now, settle(small.where("a <> b").distinct(), "edges")
        discard(before)
        was, state = state, _state(now)
        if state == was:
            return spark.createDataFrame([], "node long, root long") if state[0] == 0 else now.select(
                F.col("a").alias("node"), F.col("b").alias("root")
            ).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and two sums over them."""
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 31) - 1)), F.sum(F.hash("a", "b").cast("long"))
    ).first())
