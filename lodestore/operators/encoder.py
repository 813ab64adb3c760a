"""Learnt text vectors: TF-IDF projected on its main directions, with a vocabulary that grows.

A model is a table of columns (token, idx, df, column) and three numbers.  The
directions are found by subspace iteration over the TF-IDF weights, which lie in
blocks (``weights``); only matrices of the vectors' dimension squared reach the driver.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import text as T
from lodestore.functions import vector
from lodestore.operators import search, weights

DIM, ROUNDS, SEED = 64, 4, 42
#: Texts without a known token get the direction of this token.
UNKNOWN = "\x00__OOV__\x00"


@dataclass
class Model:
    """columns: token, idx, df, column (array of ``dim`` numbers); n_docs: texts seen; scale: the median length of the fitted columns."""

    columns: DataFrame
    n_docs: int
    dim: int
    scale: float
    singular_values: list[float]


def direction(token: str, dim: int) -> np.ndarray:
    """A unit vector that follows from the token alone."""
    seed = int.from_bytes(hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest(), "big") & 0xFFFFFFFF
    v = np.random.default_rng(seed).standard_normal(dim)
    return v / np.linalg.norm(v)


def _directions(dim: int, scale: float):
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tokens in batches:
            yield pd.Series([direction(t, dim) * scale for t in tokens])

    return of


def _weights(df: DataFrame, n_docs: int) -> DataFrame:
    return df.select("token", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def entries(docs: DataFrame, df: DataFrame, n_docs: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, token, w: the TF-IDF weights of the tokens that ``df`` (token, df) knows; unknown ones count in the length only."""
    counted = T.term_counts(docs, id_column, text_column)
    return counted.join(_weights(df, n_docs), "token").select(id_column, "token", (F.col("times") / F.col("n") * F.col("idf")).alias("w"))


def fit(docs: DataFrame, dim: int = DIM, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model of a corpus; at most as many directions as texts."""
    return fit_transform(docs, dim, rounds, id_column, text_column)[0]


def fit_transform(docs: DataFrame, dim: int = DIM, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> tuple[Model, DataFrame]:
    """The model of a corpus and what ``transform`` gives for its rows, from the last product.

    Texts are packed once; a round writes the vectors of the rows and of the tokens
    that several blocks of texts share, and deletes those of the round before.
    """
    n = docs.count()
    k = max(1, min(dim, n))
    kind = docs.schema[id_column].dataType.simpleString()
    x = weights.blocks(docs, id_column, text_column)
    held = weights.written(weights.names(x).groupBy("token").agg(F.sum("df").alias("df")))
    spread, parts = weights.spread(x), max(1, held.count() * k * 8 // weights.PART_BYTES)
    routes = weights.routes(x, parts, kind)
    texts = x.where(F.col("kind") == weights.TEXT)
    local, met = (routes.where(F.col("kind") == c) for c in (weights.LOCAL, weights.ROUTE))
    own, cuts = texts.unionByName(local), weights.slices(k)
    joined = lambda df, more: functools.reduce(DataFrame.unionByName, more, df)
    y, v, before, turn, lacked = [], [], [], np.eye(k), np.eye(k)
    for left in range(rounds, -1, -1):
        weights.discard(*before)
        before, y, lacked = y, [], turn
        first = direction if not before else None
        for cut in cuts:
            new = weights.start(routes, k, cut, direction) if first else weights.gather(joined(texts.unionByName(met), before), routes, spread, parts, cut, n, lacked)
            weights.forget_shuffles(docs)
            y.append(weights.project(joined(own.unionByName(weights.messages(new, cut, kind)), before), spread, cut, n, lacked, kind, first))
            weights.forget_shuffles(docs)
            if not left:
                v.append(new)
            elif not first:
                weights.discard(new)
        if before:
            squares, axes = np.linalg.eigh(weights.gram(y, cuts, k))
            keep = squares > squares.max() * 1e-12 if squares.max() > 0 else squares > 0
            turn = axes * np.where(keep, 1 / np.sqrt(np.where(keep, squares, 1)), 0)  # orthonormal
    squares, axes = np.linalg.eigh(weights.products(y, spread, k, turn))
    order = np.argsort(-squares)
    values, turn = np.sqrt(np.maximum(squares[order], 0)), turn @ axes[:, order]
    found = weights.written(weights.columns(v, joined(own, before), spread, parts, k, n, lacked, turn, None if before else direction))
    weights.discard(x, routes, *before, *(v if before else []))
    weights.forget_shuffles(docs)
    columns = weights.written(T.vocabulary(held).join(held, "token").join(found, "token").select("token", "idx", "df", "column"))
    weights.discard(held, found)
    weights.forget_shuffles(docs)
    norms = columns.select(vector.norm(F.col("column")).alias("n"))
    scale = norms.agg(F.percentile("n", F.lit(0.5))).first()[0]
    model = Model(columns, n, k, float(scale or 0.0) or 1.0, [float(s) for s in values])
    return model, weights.vectors(y, spread, k, id_column, kind, turn, direction(UNKNOWN, k))


def partial_fit(model: Model, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model after more texts: frequencies are added, new tokens are numbered on and get a direction of their own."""
    df = T.document_frequency(docs, id_column, text_column)
    merged = T.merged_frequency(model.columns.select("token", "df"), df)
    grown = T.grown_vocabulary(model.columns.select("token", "idx"), df)
    old = model.columns.select("token", "column")
    columns = grown.join(merged, "token").join(old, "token", "left").select("token", "idx", "df", F.coalesce("column", _directions(model.dim, model.scale)("token")).alias("column"))
    return Model(columns.checkpoint(), model.n_docs + docs.count(), model.dim, model.scale, model.singular_values)


def transform(model: Model, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, embedding: unit vectors of all rows; a text without a known token gets the unknown direction."""
    kind = docs.schema[id_column].dataType.simpleString()
    x, k = weights.blocks(docs, id_column, text_column), model.dim
    texts, spread, y = x.where(F.col("kind") == weights.TEXT), weights.spread(x), []
    for cut in weights.slices(k):
        rows = texts.unionByName(weights.known(x, model.columns, cut, kind))
        y.append(weights.project(rows, spread, cut, model.n_docs, np.eye(k), kind))
    weights.discard(x)
    return weights.vectors(y, spread, k, id_column, kind, np.eye(k), direction(UNKNOWN, k))


def save(model: Model, path: str) -> None:
    model.columns.write.mode("overwrite").parquet(f"{path}/columns")
    numbers = json.dumps({"n_docs": model.n_docs, "dim": model.dim, "scale": model.scale, "singular_values": model.singular_values})
    model.columns.sparkSession.createDataFrame([(numbers,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> Model:
    return Model(spark.read.parquet(f"{path}/columns"), **json.loads(spark.read.text(f"{path}/numbers").first().value))


# ---------------------------------------------------------------- the flat store


@dataclass
class FlatStore:
    """Vectors of all users in one table (userId, action, text, embedding, ...), searched exactly; a model or hashed vectors encode."""

    rows: DataFrame | None = None
    model: Model | None = None

    def encode(self, texts: DataFrame) -> DataFrame:
        """``texts`` (key, text) with ``embedding``."""
        if self.model is None:
            return texts.withColumn("embedding", T.hash_embedding()("text").cast("array<double>"))
        return texts.join(transform(self.model, texts, "key"), "key")

    def add(self, events: DataFrame, user_id) -> FlatStore:
        """The store with more events (key, text, ...) of a user."""
        new = self.encode(events).withColumn("userId", F.lit(user_id))
        return FlatStore(new if self.rows is None else self.rows.unionByName(new, allowMissingColumns=True), self.model)

    def clear(self) -> FlatStore:
        return FlatStore(None, self.model)

    def search(self, query: list[float], user_id, k: int = 5, threshold: float = 0.0) -> DataFrame:
        """The user's k nearest rows at the threshold, with score and rank."""
        if self.rows is None:
            raise ValueError("the store is empty")
        mine = self.rows.where(F.col("userId") == user_id).withColumnRenamed("key", "vec_id")
        return search.similarity_search(mine, query, k, threshold).withColumnRenamed("vec_id", "key")

    def recall(self, text: str, user_id, k: int = 5, threshold: float = 0.7) -> DataFrame:
        """The same for a text."""
        if self.rows is None:
            raise ValueError("the store is empty")
        spark = self.rows.sparkSession
        asked = self.encode(spark.createDataFrame([(0, text)], "key long, text string")).first()
        return self.search(list(asked.embedding), user_id, k, threshold)

    def save(self, path: str) -> None:
        if self.rows is not None:
            self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        if self.model is not None:
            save(self.model, f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str, with_model: bool = False) -> FlatStore:
        return FlatStore(spark.read.parquet(f"{path}/rows"), load(spark, f"{path}/model") if with_model else None)
