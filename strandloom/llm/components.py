"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, save


#: Edge tables up to this size stay in one partition: a round of them needs no shuffle, and beyond it a round is dealt as usual.
SMALL_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of every node to the smallest of them and the node itself.

    ``edges`` holds (a, b) with a > b.  Large star moves neighbours above the
    node, small star those below it and the node itself.  The minimum is a
    partial aggregate, so a node with many neighbours isn't gathered.
    """
    pairs = lambda *ends: F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends)))
    if large:
        both = edges.select(pairs(("a", "b"), ("b", "a")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        moved = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(low, "a").select(pairs(("b", "low"), ("a", "low")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 40, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    ``edges`` has two columns of one orderable type.  Self loops and repeats are
    ignored; an empty table gives no rows.  Each round is written to the shared
    folder.  Rounds grow with the logarithm of the longest path.  Tables of at
    most ``small`` edges, counted before each round, stay in one task; the result
    is the same.
    """
    a, b = edges.columns[:2]
    edges = save(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "components")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state, before = now, edges
        dealt = edges.coalesce(1) if now[0] <= small else edges
        edges = save(_star(_star(dealt, True), False), "components")
        discard(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
