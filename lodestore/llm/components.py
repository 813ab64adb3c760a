"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds suffice for chains of 2 ** 60 nodes in practice; more means a defect.
MOST_ROUNDS = 60
#: Neighbours from which a node counts as a hub, at least, and the bound of the hubs' number as a power of two.
HUB, HUBS = 1 << 15, 14
#: Edges that are worth a task.
TASK = 1 << 15


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of a link (columns a, b, of one type), the least node it is connected to.

    Every step is an aggregation, combined before the shuffle, and a join on the
    node, in which hubs are broadcast; the edge table is checkpointed after each
    round, so a lost executor costs one round at most.
    """
    spark = links.sparkSession
    _checkpoints(spark)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        tasks = max(1, -(-mark[0] // TASK))  # as many as there is work for; more than there are partitions change nothing
        edges = edges.coalesce(tasks)
        # large star: every neighbour above u is linked to the least neighbour of u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("v > u"), least, mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        # small star: u and its neighbours below are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = _with_least(large, least, mark[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components: the links did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with the least neighbour m of u; the few nodes of very many neighbours are broadcast, so their rows stay where they are."""
    if edges <= HUB:  # no node can have so many neighbours
        return rows.join(least.select("u", "m"), "u")
    many = max(HUB, edges >> HUBS)  # 2 ** (HUBS + 1) nodes at most have more neighbours
    hubs = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= many).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _mark(edges: DataFrame) -> tuple[int, int | None, int | None]:
    """Equal for equal tables of distinct edges; others agree in all three numbers by no chance that matters."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(row)


def _checkpoints(spark) -> None:
    from lodestore.llm import _shared

    folder = _shared.checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
