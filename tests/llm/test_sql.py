"""The operators' SQL against the operators, over fixtures with links, secrets and odd rows."""

import duckdb
import numpy as np
import pytest
from test_secrets import cases

from lodestore.llm import registry


def rows(frame):
    return sorted(tuple(str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def test_documents(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert (~same(spark, tmp_path, "op10_minhash_near_dup", "documents").kept).sum() > 10


def test_secrets(spark, tmp_path):
    spark.createDataFrame(list(enumerate(cases())), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert (same(spark, tmp_path, "op7_secret_scans", "documents").spans != "").sum() > 10


@pytest.mark.parametrize("rows_of", [0, 200])
def test_vectors(spark, tmp_path, rows_of):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    data = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16) * 0.05 * (i % 3)], i % 2) for i in range(rows_of)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [None, 1.0], 0)][: rows_of]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = same(spark, tmp_path, "op2_embedding_near_dup", "embeddings")
    assert len(got) == len(data) and (not rows_of or (~got.kept).sum() > 10)
