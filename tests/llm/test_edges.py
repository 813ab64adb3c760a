"""Every operator and stage over tables that are empty, hold nulls, repeated rows, or columns of names that it uses itself."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestore.llm import registry

#: Names that the operators give to columns of their own.
CLASHING = ["score", "key", "run", "ids", "data", "n", "fp", "mark", "group", "sketch", "w", "row", "cells", "digest", "media", "payload", "spans", "base_spans", "part", "win", "held_out", "start", "kept", "component_id", "bit", "v", "cid", "e", "m", "rep"]
ROWS = [(1, "Some words of a text, of a text"), (2, None), (3, ""), (None, "Some words of a text, of a text"), (3, "a b"), (3, "a b"), (4, "token = abcdefgh12 \x00 é漢😀 " * 30), (5, "x" * 3000)]
PAGES = [(1, "u", "<article><p>One</p></article>"), (None, None, None), (2, "u", ""), (1, "u", "<article><p>One</p></article>")]
VECTORS = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], None), (2, None, 1), (3, [0.0, 0.0], 1), (3, [0.0, 0.0], 1)]
LABELS = [(i, 1, int(i == 1)) for i in range(1, 6)] + [(None, None, None), (1, None, None)]


def written(spark, folder, empty, clashing):
    tables = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, t, None, "s", None) for i, t in ROWS]),
        "pages": ("page_id long, url string, html string", PAGES), "embeddings": ("vec_id long, embedding array<float>, label int", VECTORS), "labels": ("doc_id long, quality int, toxic int", LABELS),
    }
    for name, (schema, rows) in tables.items():
        df = spark.createDataFrame([] if empty else rows, schema)
        if clashing:
            df = df.select(*df.columns, *[F.lit(None if c == "score" else "own").cast("string").alias(c) for c in CLASHING if c not in df.columns])
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def answers(df):
    return sorted(tuple(repr(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_operators(spark, tmp_path, name):
    plain = written(spark, tmp_path / "plain", False, False)
    query = registry.QUERIES[name]
    got = query(spark, plain)
    found = answers(got)
    source = PAGES if "html" in name else VECTORS if "embedding" in name else ROWS
    if "packing" not in name:
        assert len(found) == len(source)
    none = query(spark, written(spark, tmp_path / "empty", True, False))
    assert none.columns == got.columns and none.count() == 0
    assert answers(query(spark, written(spark, tmp_path / "clashing", False, True))) == found


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    for empty in (True, False):
        folder = written(spark, tmp_path / str(empty), empty, True)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        if k < 3:
            assert out.columns == docs.columns
            kept = out.count()
            assert kept == 0 if empty else kept > 0
            # other columns and rows without words stay as they are
            assert empty or out.where("part = 'own'").count() == kept and out.where("doc_id = 2").count() == 1
        else:
            assert "sequence_id" in out.columns and (out.count() == 0) == empty
    assert public_tokenizers.path("word_bpe_49k.json")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, True, False)).count() == 0


def test_stages_begin_with_memory_given_back(spark, docs, monkeypatch):
    """Each stage has driver and executors collect in full before it runs; a heap that earlier stages grew would stay."""
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))
    seen = []
    for module, name in ((corpus_pipeline.toxicity, "train"), (corpus_pipeline.near_dup, "deduplicate"), (corpus_pipeline.secrets, "redact"), (corpus_pipeline.packing, "pack")):
        monkeypatch.setattr(module, name, lambda d, *a: seen.append(beans()) or d)
    monkeypatch.setattr(corpus_pipeline.toxicity, "reject", lambda d, model: d)
    monkeypatch.setattr(corpus_pipeline._shared, "table", lambda *a: None)
    before = beans()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "")
    assert all(y - x >= 2 for x, y in zip([before, *seen], seen, strict=False)) and len(seen) == 4  # the driver's own, and one where tasks run
