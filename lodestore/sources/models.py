"""Small models on disk: quantisers, settings of hashed vectors, neighbour lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_quantiser(model: DataFrame, path: str, basis: list[list[float]] | None = None) -> None:
    """One row: the scale and offset of each dimension, and the directions of the residual codes."""
    directions = F.array(*[F.array(*map(F.lit, b)) for b in basis]) if basis else F.array().cast("array<array<double>>")
    model.select("scale", "offset", directions.alias("basis")).write.mode("overwrite").parquet(path)


def load_quantiser(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_hashing(spark: SparkSession, path: str, dim: int = 256, low: int = 3, high: int = 5) -> None:
    rows = spark.createDataFrame([(json.dumps({"dim": dim, "low": low, "high": high}),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)


def load_hashing(spark: SparkSession, path: str) -> dict[str, int]:
    """The arguments of ``hash_vector``; its defaults where nothing was saved."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return {"dim": 256, "low": 3, "high": 5}
    return json.loads(spark.read.text(path).first().value)


def save_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst and what else was saved; of the older form (src, neighbours: a list) a row for each neighbour."""
    rows = spark.read.parquet(path)
    return rows.withColumn("dst", F.explode("neighbours")).drop("neighbours") if "neighbours" in rows.columns else rows
