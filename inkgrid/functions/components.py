"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions.tables import dropped, written


#: Edges a task; few edges on many partitions would cost more in files than in work.
EDGES_A_TASK = 200_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step on edges (a > b): every node hands neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m")).coalesce(tasks)
    handed = both.join(least, "a").coalesce(tasks)
    if large:
        return handed.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct().coalesce(tasks)
    moved = handed.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct().coalesce(tasks)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes with an edge and the smallest node of their component: node, component.

    ``edges`` has long columns ``a`` and ``b`` in any order. Each round shuffles edges only, with a
    partial minimum before the shuffle, and is written to the shared folder, whereupon the one before
    it goes. It ends when a round changes nothing.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    mark = now.agg(*state).first()
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        tasks = min(most, 1 + mark[0] // EDGES_A_TASK)
        old, now = now, written(_star(_star(now.coalesce(tasks), True, tasks), False, tasks), "edges")
        dropped(old)
        was, mark = mark, now.agg(*state).first()
        if was == mark:
            break
    else:
        raise RuntimeError("components have not settled")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
