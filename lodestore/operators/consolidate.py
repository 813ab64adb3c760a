"""Consolidation: memory weights, pruning, merge pairs, centroids, and the merge of episodic memories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators import blocks

STABILITY_DAYS, FREQUENCY, CONFLICT, PRUNE, MERGE, MOST_MERGES = 2.0, 0.5, 0.4, 0.05, 0.96, 50


def bio_weights(df: DataFrame, prune_threshold: float = PRUNE) -> DataFrame:
    """``df`` (user_id, age_h, reinforcements) with its weight, the user's greatest being 1, and whether to prune it."""
    conflict = F.col("conflict_score") if "conflict_score" in df.columns else F.lit(0.0)
    raw = F.exp(-F.col("age_h") / (24 * STABILITY_DAYS)) * (1 + FREQUENCY * F.col("reinforcements")) * F.greatest(F.lit(0.0), 1 - CONFLICT * conflict)
    own, best = "bio_weights: raw", "bio_weights: most"
    most = df.withColumn(own, raw).groupBy("user_id").agg(F.max(own).alias(best))  # combined before the shuffle
    weighed = df.withColumn(own, raw).join(most, "user_id").withColumn("weight", F.when(F.col(best) > 0, F.col(own) / F.col(best)).otherwise(0.0))
    return weighed.drop(own, best).withColumn("prune", (F.col("weight") < prune_threshold) & (F.col("age_h") > 24))


def apply_weights(df: DataFrame, weights: DataFrame, key: str = "event_id") -> DataFrame:
    """``df`` with ``bio_weight`` put into 0..1 from ``weights`` (key, weight); rows without one keep theirs."""
    new = weights.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))).alias("apply_weights: new"))
    old = F.col("bio_weight") if "bio_weight" in df.columns else F.lit(1.0)
    return df.join(new, key, "left").withColumn("bio_weight", F.coalesce("apply_weights: new", old)).drop("apply_weights: new")


def cycle(df: DataFrame, threshold: float = MERGE, most: int = MOST_MERGES, prune_threshold: float = PRUNE) -> tuple[DataFrame, DataFrame]:
    """(merged memories, statistics) of one consolidation: weights, pruning, merging.

    df: user_id, vec_id, event_id, age_h, ts (seconds), reinforcements, embedding.
    Statistics: user_id, weights_updated, pruned, merged.
    """
    weighed = bio_weights(df, prune_threshold)
    left = weighed.where(~F.col("prune")).select("user_id", F.col("event_id").alias("vec_id"), "ts", "reinforcements", "embedding")
    merged = episodic_merge(left, threshold, most)
    counts = weighed.groupBy("user_id").agg(F.count(F.lit(1)).alias("weights_updated"), F.count_if("prune").alias("pruned"))
    merges = merged.groupBy("user_id").agg(F.count(F.lit(1)).alias("merged"))
    return merged, counts.join(merges, "user_id", "left").withColumn("merged", F.coalesce("merged", F.lit(0)))


def merge_pairs(df: DataFrame, threshold: float, group: str = "label") -> DataFrame:
    """group, a < b, sim: the rows of one group whose vectors are similar enough, by matrix products in blocks."""
    return blocks.similar_pairs(df, threshold, group)


def centroids(df: DataFrame, group: str = "label") -> DataFrame:
    """group, pos, mean: the mean vector of each group by component, combined before the shuffle."""
    return df.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def episodic_merge(df: DataFrame, threshold: float = MERGE, most: int = MOST_MERGES, key: str = "user_id") -> DataFrame:
    """Merged memories of each user: the first unmerged row gathers later rows like it, in order of vec_id.

    df: key, vec_id, ts (seconds), reinforcements (at most 2 take part), embedding.
    A user's rows are one task's group: the fold is sequential by definition.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        unit = np.array(rows.embedding.tolist(), dtype=np.float64).reshape(len(rows), -1)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        ids, ts, n = rows.vec_id.to_numpy(), rows.ts.to_numpy(), rows.reinforcements.to_numpy()
        free, out = np.ones(len(rows), dtype=bool), []
        for i in range(len(rows)):
            if len(out) >= most:
                break
            if not free[i]:
                continue
            later = np.flatnonzero(free[i + 1 :]) + i + 1
            near = later[unit[later] @ unit[i] >= threshold]
            if not len(near):
                continue
            cluster = np.concatenate([[i], near])
            free[cluster] = False
            centre = unit[cluster].mean(axis=0)
            size = np.linalg.norm(centre)
            best = cluster[int(ts[cluster].argmax())]
            out.append((rows[key].iloc[0], ids[best], ids[cluster].tolist(), int(n[cluster].sum()), float(ts[cluster].max()), (centre / size if size else centre).tolist()))
        return pd.DataFrame(out, columns=[key, "representative", "merged_from", "reinforcements", "ts", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, representative long, merged_from array<long>, reinforcements long, ts double, embedding array<double>"
    return df.where("reinforcements <= 2").select(key, "vec_id", "ts", "reinforcements", "embedding").groupBy(key).applyInPandas(fold, schema)
