"""The memories table of the test data and the recall operators over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import decay, vector
from lodestore.operators import blocks, chains, search

#: 2024-01-31 00:00:00 UTC in seconds.
NOW = 1706659200.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Unix seconds of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(1e6)


def age_hours(ts: Column, now: float = NOW) -> Column:
    return (F.lit(now) - seconds(ts)) / F.lit(3600.0)


def memories(spark: SparkSession, sf_dir: str, now: float = NOW) -> DataFrame:
    """Events with the vector they point at, their reinforcements and their age."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    n = max(1, vectors.count())  # from the file footers
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts").withColumn("vec_id", F.col("event_id") % n)
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("reinforcements"))  # combined before the shuffle
    return events.join(counts, ["user_id", "event_type"]).join(vectors, "vec_id").withColumn("age_h", age_hours(F.col("ts"), now))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of that id; empty where there is none."""
    found = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(found[0]) if found and found[0] else []


def with_cosine(df: DataFrame, query: list[float]) -> DataFrame:
    return df.withColumn("cosine", vector.dot(F.col("embedding"), vector.literal(query)))


def manager_recall(df: DataFrame, query: list[float], k: int = 5, threshold: float = 0.05, status: Column | None = None) -> DataFrame:
    """Per user: six k nearest, rounded and cut to three k, the active ones re-ranked by cosine, decay and boost.

    Archived rows take up places before they are dropped, so fewer than k may come back.
    """
    status = status if status is not None else F.lit("active")
    scored = with_cosine(df, query).withColumn("status", status)
    near = search.ranked(scored, "user_id", 6 * k, "cosine", "event_id").withColumn("cosine", F.round("cosine", 4)).drop("rank")
    near = search.ranked(near.where(F.col("cosine") >= 0), "user_id", 3 * k, "cosine", "event_id").drop("rank")
    active = near.where(F.col("status") == "active")
    final = active.withColumn("score", F.col("cosine") * decay.preset("human", F.col("age_h")) * decay.freq_boost(F.col("reinforcements")))
    return search.ranked(final.where(F.col("score") >= threshold), "user_id", k, "score", "event_id")


MODES = ("semantic", "temporal", "contextual", "summary", "chain")
#: Rows of a user whose neighbours the chain mode adds.
CHAIN_SEEDS = 3


def passing(df: DataFrame, status: str = "active", category: str | None = None, max_age_hours: float | None = None) -> DataFrame:
    """The candidates of a recall: rows of that status (``all``: any; a table without the column is active), category and age."""
    if status != "all" and "status" in df.columns:
        df = df.where(F.coalesce("status", F.lit("active")) == status)
    elif status not in ("all", "active"):
        df = df.limit(0)
    if "deleted" in df.columns:
        df = df.where(~F.coalesce("deleted", F.lit(False)))
    if category is not None:
        df = df.where(F.col("category") == category)
    return df if max_age_hours is None else df.where(F.col("age_h") <= max_age_hours)


def recall(
    df: DataFrame, query: list[float], mode: str = "contextual", k: int = 5, min_score: float = 0.0, recalls: DataFrame | None = None, filters: Column | None = None, chain_sim: float = 0.55,
    status: str = "active", category: str | None = None, max_age_hours: float | None = None,
) -> DataFrame:
    """Per user the k best rows of an exhaustive scoring; ``recalls`` (user_id, event_id, recalled_h) lifts what was recalled lately.

    Only active rows take part unless ``status`` says otherwise.  The chain mode
    scores as the contextual one and adds the neighbours of a user's best rows,
    whatever the filters say.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    rows = passing(df, status, category, max_age_hours)
    rows = with_cosine(rows if filters is None else rows.where(filters), query)
    score = F.col("cosine")
    if mode != "semantic":
        score = score * decay.exponential(F.col("age_h"), 24.0, 0.05)
    if mode in ("contextual", "summary", "chain"):
        if recalls is not None:
            rows = rows.join(recalls, ["user_id", "event_id"], "left")
        lift = decay.recency_boost(F.col("recalled_h")) if recalls is not None else F.lit(1.0)
        score = score * decay.freq_boost(F.col("reinforcements")) * lift
    rows = rows.withColumn("score", decay.final(score))
    if mode == "chain":
        rows = _with_neighbours(rows, df, k, chain_sim)
    return search.ranked(rows.where(F.col("score") >= min_score), "user_id", k, "score", "event_id")


def _with_neighbours(base: DataFrame, df: DataFrame, k: int, threshold: float) -> DataFrame:
    """The base and, for each of a user's best rows, the k best within one hop; of a row found twice the base's or the better seed's stays."""
    seeds = search.ranked(base, "user_id", CHAIN_SEEDS, "score", "event_id").select("user_id", F.col("rank").alias("seed"), F.col("event_id").alias("src"), F.col("embedding").alias("from"))
    near = df.join(seeds, "user_id").where("event_id <> src").withColumn("cosine", vector.dot(F.col("from"), F.col("embedding"))).where(F.col("cosine") >= threshold)
    near = near.withColumn("score", decay.final(F.col("cosine") * decay.exponential(F.col("age_h"), 24.0, 0.05)))
    best = F.row_number().over(Window.partitionBy("user_id", "seed").orderBy(F.desc("score"), "event_id"))
    near = near.withColumn("best", best).where(F.col("best") <= k).drop("best", "src", "from")
    first = F.row_number().over(Window.partitionBy("user_id", "event_id").orderBy("seed"))
    together = base.withColumn("seed", F.lit(0)).unionByName(near, allowMissingColumns=True)
    return together.withColumn("first", first).where("first = 1").drop("first", "seed")


def feedback(rows: DataFrame, found: DataFrame, now_h: float = 0.0) -> DataFrame:
    """``rows`` after a recall: what was found (user_id, event_id) is reinforced and logged as recalled ``now_h`` hours ago."""
    hits = found.select("user_id", "event_id").distinct().withColumn("feedback: hit", F.lit(True))
    had = lambda c, other: F.col(c) if c in rows.columns else F.lit(other)
    joined = rows.join(hits, ["user_id", "event_id"], "left")
    hit = F.col("feedback: hit").isNotNull()
    return joined.select(
        *[F.col(c) for c in rows.columns if c not in ("reinforcements", "recall_count", "recalled_h")],
        (F.col("reinforcements") + hit.cast("int")).alias("reinforcements"), (had("recall_count", 0) + hit.cast("int")).alias("recall_count"),
        F.when(hit, F.lit(now_h)).otherwise(had("recalled_h", None)).cast("double").alias("recalled_h"),
    )


def neighbour_edges(vectors: DataFrame, threshold: float, group: str = "label", most: int | None = None) -> DataFrame:
    """src, dst, sim: both directions of the pairs of a group that are similar enough, of each node the ``most`` nearest."""
    return blocks.neighbour_graph(vectors, threshold, most, group)


def recall_chain(edges: DataFrame, seeds: DataFrame, depth: int, weight: DataFrame, k: int) -> DataFrame:
    """seed, vec_id, depth, score: what each seed reaches within ``depth`` hops, nearest hop first.

    A node's score is its similarity to the best parent of the hop before, times its own weight.
    """
    frontier = seeds.select(F.col("vec_id").alias("seed"), "vec_id", F.lit(0.0).alias("sim"))
    seen = frontier.select("seed", "vec_id", F.lit(0).alias("depth"), "sim")
    for hop in range(1, depth + 1):
        reached = frontier.select("seed", F.col("vec_id").alias("src")).join(edges, "src").groupBy("seed", F.col("dst").alias("vec_id")).agg(F.max("sim").alias("sim"))
        frontier = reached.join(seen.select("seed", "vec_id"), ["seed", "vec_id"], "left_anti")
        seen = seen.unionByName(frontier.select("seed", "vec_id", F.lit(hop).alias("depth"), "sim"))
    scored = seen.where("depth > 0").join(weight, "vec_id").withColumn("score", decay.final(F.col("sim") * F.col("weight")))
    w = Window.partitionBy("seed").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("seed", "vec_id", "depth", "score", "rank")


def similar_chains(vectors: DataFrame, asked: Column, threshold: float, weight: Column, k: int) -> DataFrame:
    """``recall_chain`` to two hops over the edges between similar vectors of a label, from the rows that are asked for; no edge table is made.

    Where an id repeats its rows are one node, which takes that table.
    """
    weighted = vectors.withColumn("weight", weight)
    ids = vectors.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    if ids[0] != ids[1]:
        return recall_chain(neighbour_edges(vectors, threshold), vectors.where(asked), 2, weighted.select("vec_id", "weight"), k)
    return chains.two_hops(weighted.withColumn("asked", F.coalesce(asked, F.lit(False))), threshold, k)


def context_block(found: DataFrame, budget: int = 800) -> DataFrame:
    """Per user the ranked lines (line, rank) that fit a budget of characters, joined."""
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = found.withColumn("used", F.sum(F.length("line")).over(w)).where(F.col("used") <= budget)
    listed = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))  # budget bounds the group
    return listed.select("user_id", F.array_join(F.col("lines.line"), "\n").alias("context"), F.size("lines").alias("n_lines"))


HEADER, NOTHING = "## User Memory Context", "(no relevant memories found)"


def context_text(found: DataFrame, budget: int = 800, text: str = "text") -> DataFrame:
    """Per user the text that goes into a prompt: a header, the ranked lines with their age that fit the budget, a footer.

    found: user_id, rank, age_h and the text column.  The header counts towards the
    budget, and the first line that does not fit ends the list.
    """
    header = F.concat(F.lit(HEADER + " \u2014 "), F.col("user_id").cast("string"))
    lines = found.withColumn("line", F.concat(F.lit("- ["), decay.age_text(F.col("age_h")), F.lit("] "), F.col(text)))
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.length(header) + F.sum(F.length("line")).over(w)) <= budget
    listed = lines.withColumn("fits", fits).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "line")))).alias("lines")  # the budget bounds the list
    )
    footer = F.format_string("\n(based on %d memories, ranked by relevance \u00d7 recency \u00d7 frequency)", F.col("n"))
    return listed.select("user_id", F.concat_ws("\n", header, F.array_join(F.col("lines.line"), "\n"), footer).alias("context"), F.size("lines").alias("n_lines"))
