"""Exact similarity search: single, batched, per tenant, with thresholds; 8-bit search; recall@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import vector
from lodestore.operators import blocks

def top_k(corpus: DataFrame, query: list[float], k: int, threshold: float | None = None, id_column: str = "vec_id") -> DataFrame:
    """The k most similar rows: a bounded heap a task, one merge; no sort of the corpus."""
    scored = corpus.withColumn("score", vector.dot(F.col("embedding"), vector.literal(query)))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def ranked(scored: DataFrame, group: str, k: int, score: str, id_column: str) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each task's groups to k before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), id_column)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank for a stated set of queries (query_id, qv) against all rows, by matrix products in blocks."""
    return blocks.top_k(corpus, queries, k, threshold)


def similarity_search(corpus: DataFrame, query: list[float], k: int = 3, threshold: float = 0.7) -> DataFrame:
    """``corpus`` rows with ``score`` and ``rank``: the k nearest by the product with the normalised query, cut at the threshold."""
    size = sum(x * x for x in query) ** 0.5
    found = top_k(corpus, [x / size for x in query] if size else query, k, threshold)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))  # k rows


def engine_search(corpus: DataFrame, query: list[float], k: int, threshold: float) -> DataFrame:
    """Twice as many rows as asked for, their scores rounded, then the threshold, then the cut."""
    found = top_k(corpus, query, 2 * k).withColumn("score", F.round("score", 4))
    return found.where(F.col("score") >= threshold).orderBy(F.desc("score"), "vec_id").limit(k)


def sq8_fit(corpus: DataFrame) -> DataFrame:
    """pos, scale, offset of an 8-bit quantiser, from every row."""
    each = corpus.select(F.posexplode("embedding").alias("pos", "x"))
    bounds = each.groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    spread = F.col("hi") - F.col("lo")
    return bounds.select("pos", F.when(spread > 0, spread / 255).otherwise(F.lit(1.0 / 255)).alias("scale"), F.col("lo").alias("offset"))


def sq8_model(corpus: DataFrame) -> DataFrame:
    """One row: the quantiser's scale and offset arrays."""
    listed = sq8_fit(corpus).agg(F.array_sort(F.collect_list(F.struct("pos", "scale", "offset"))).alias("m"))  # one row a dimension
    return listed.select(F.col("m.scale").alias("scale"), F.col("m.offset").alias("offset"))


def sq8_encode(corpus: DataFrame) -> DataFrame:
    """``corpus`` with ``scale``, ``offset`` and ``code``."""
    model = F.broadcast(sq8_model(corpus))
    return corpus.crossJoin(model).withColumn("code", vector.sq8_encode(F.col("embedding"), F.col("scale"), F.col("offset")))


def factored(query: list[float], scale: list[float], offset: list[float]) -> tuple[list[float], float]:
    """A query made once for all codes: its product with a decoded vector is ``code . first + second``."""
    return [q * s for q, s in zip(query, scale, strict=True)], sum(q * o for q, o in zip(query, offset, strict=True))


def coded_product(code: Column, query: list[float], scale: list[float], offset: list[float]) -> Column:
    """The product of a query and a coded vector, without decoding it."""
    scaled, rest = factored(query, scale, offset)
    return vector.dot(code, F.array(*map(F.lit, scaled))) + F.lit(rest)


def sq8_search(coded: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest rows of a coded table (code, and the quantiser's scale and offset on each row)."""
    model = coded.select("scale", "offset").first()  # two numbers a dimension
    if model is None:
        return coded.withColumn("score", F.lit(None).cast("double")).limit(0)
    return coded.withColumn("score", coded_product(F.col("code"), query, model.scale, model.offset)).orderBy(F.desc("score"), "vec_id").limit(k)


def quantise_from(corpus: DataFrame, least: int = 100) -> DataFrame:
    """The coded table, or the table as it is while it has fewer vectors."""
    return sq8_encode(corpus) if corpus.limit(least).count() >= least else corpus


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of the true neighbours (query_id, vec_id) that were found."""
    hits = truth.join(found, ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    asked = truth.agg(F.countDistinct("query_id").alias("asked"))
    return hits.crossJoin(asked).select((F.col("hits") / (F.col("asked") * k)).alias("recall"))


def residual_basis(coded: DataFrame, size: int = 8, most: int = 2000) -> list[list[float]]:
    """The directions that hold most of the quantisation error, from at most ``most`` rows of lowest id hash."""
    import numpy as np

    error = F.zip_with(F.col("embedding").cast("array<double>"), vector.sq8_decode(F.col("code"), F.col("scale"), F.col("offset")), lambda x, y: x - y)
    rows = coded.select("vec_id", error.alias("e")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    if not rows:
        return []
    return np.linalg.svd(np.array([r.e for r in rows]), full_matrices=False)[2][:size].tolist()


def with_residual(coded: DataFrame, basis: list[list[float]]) -> DataFrame:
    """Adds ``residual``: the error's components along the basis, in single precision."""
    error = F.zip_with(F.col("embedding").cast("array<double>"), vector.sq8_decode(F.col("code"), F.col("scale"), F.col("offset")), lambda x, y: x - y)
    parts = [vector.dot(F.col("__error"), F.array(*map(F.lit, b))).cast("float") for b in basis]
    return coded.withColumn("__error", error).withColumn("residual", F.array(*parts)).drop("__error")


def residual_search(coded: DataFrame, query: list[float], basis: list[list[float]], k: int) -> DataFrame:
    """Top-k by the coded product plus what the residual adds: ``u . q + residual . (B q)``."""
    model = coded.select("scale", "offset").first()
    if model is None or not basis:
        return coded.withColumn("score", F.lit(None).cast("double")).limit(0)
    projected = [sum(x * y for x, y in zip(b, query, strict=True)) for b in basis]
    score = coded_product(F.col("code"), query, model.scale, model.offset) + vector.dot(F.col("residual"), F.array(*map(F.lit, projected)))
    return coded.withColumn("score", score).orderBy(F.desc("score"), "vec_id").limit(k)
