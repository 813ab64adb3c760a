"""Session summaries: noise out, messages clustered around the first of their kind, one fact a cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.functions import text as T


def session_facts(messages: DataFrame, min_length: int = 4, similarity: float = 0.85, max_facts: int = 10, dim: int = 256) -> DataFrame:
    """conv_id, fact_no, text, source_count, category; largest clusters first, the wordiest message speaks for its cluster."""

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn", kind="stable")
        memory: dict = {}
        texts = rows.text.tolist()
        unit = np.array([T.hash_vector(t, dim, memory=memory) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        free, groups = np.ones(len(texts), dtype=bool), []
        for i in range(len(texts)):
            if not free[i]:
                continue
            near = np.flatnonzero(free & (unit @ unit[i] >= similarity) & (np.arange(len(texts)) > i)) if unit[i].any() else np.empty(0, int)
            group = [i, *near.tolist()]
            free[group] = False
            groups.append(group)
        groups.sort(key=len, reverse=True)
        out = [(rows.conv_id.iloc[0], k, max((texts[i] for i in g), key=lambda t: len(t.split())), len(g)) for k, g in enumerate(groups[:max_facts])]
        return pd.DataFrame(out, columns=["conv_id", "fact_no", "text", "source_count"])

    clean = messages.where(T.is_substantial(F.col("text"), min_length)).select("conv_id", "turn", "text")
    facts = clean.groupBy("conv_id").applyInPandas(cluster, "conv_id long, fact_no int, text string, source_count int")
    return facts.withColumn("category", T.category(F.col("text")))
