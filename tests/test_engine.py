"""The engine: golden values, SQL on the smallest data, folds, log, snapshots, streams."""

import hashlib
import json
import math
import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.functions import decay, vector
from lodestore.functions import text as T
from lodestore.operators import chains, consolidate, memories, remember, session
from lodestore.plans import catalogue
from lodestore.sources import change_log
from lodestore.streaming import remember as streams

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    return sorted(tuple(repr(round(v, 8)) if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_decay_at_tier_edges(spark):
    ages = [-1.0, 0.0, 0.5, 1.0, 24.0, 24.001, 168.0, 720.0, 2000.0]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    got = [r.w for r in df.select(decay.preset("human", F.col("a")).alias("w")).collect()]
    assert got == [1.0, 1.0, 1.0, 0.8, 0.55, 0.55, 0.25, 0.05, 0.05]
    got = df.select(decay.exponential(F.col("a"), 24.0, 0.05).alias("w")).collect()[4].w
    assert got == pytest.approx(0.5)


def test_boost_and_normalize(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (10, [0.0, 0.0])], "n int, v array<double>")
    got = df.select(decay.freq_boost(F.col("n")).alias("b"), vector.normalize(F.col("v")).alias("u")).collect()
    assert got[0].b == pytest.approx(1 + 0.3 * math.log(2) / math.log(11)) and got[1].b == pytest.approx(1.3)
    assert got[0].u == [0.6, 0.8] and got[1].u == [0.0, 0.0]


def test_hash_bucket_and_vector(spark):
    value = int.from_bytes(hashlib.blake2b(b"#chat", digest_size=8).digest(), "big")
    assert T.bucket("#chat", 256) == (value % 256, 1.0 if (value // 256) & 1 else -1.0)
    assert not T.hash_vector("¿!", 64).any()
    assert np.linalg.norm(T.hash_vector("un chat", 64)) == pytest.approx(1)


def test_conflict_fold_reinforces_archives_and_caps(spark):
    e = [[1.0, 0.0], [1.0, 0.01], [0.7, 0.7], [0.0, 1.0], [0.0, -1.0]]
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate(e)], "user_id long, event_id long, ts double, embedding array<double>")
    got = [(r.event, r.mem_id, r.archived) for r in remember.conflict_fold(df).orderBy("event_id").collect()]
    assert got == [("stored", 0, []), ("reinforced", 0, []), ("conflict", 1, [0]), ("conflict", 2, [1]), ("stored", 3, [])]
    store = remember.Store()
    for i in range(6):
        angle = i * math.acos(0.6)
        store.remember(np.array([math.cos(angle), math.sin(angle)]), float(i))
    assert len(store.archived) <= remember.KEEP_ARCHIVED and not {i for _, i in store.archived} & set(store.vectors)


def test_episodic_merge_takes_the_latest_as_representative(spark):
    data = [(1, 0, 5.0, 1, [1.0, 0.0]), (1, 1, 9.0, 2, [1.0, 0.0]), (1, 2, 1.0, 1, [0.0, 1.0]), (1, 3, 1.0, 3, [1.0, 0.0])]
    df = spark.createDataFrame(data, "user_id long, vec_id long, ts double, reinforcements int, embedding array<double>")
    r = consolidate.episodic_merge(df).collect()
    assert [(x.representative, x.merged_from, x.reinforcements, x.ts) for x in r] == [(1, [0, 1], 3, 9.0)]


def test_session_facts(spark):
    text = "please remember the quarterly report deadline"
    df = spark.createDataFrame([(1, 0, text), (1, 1, "ok"), (1, 2, text), (1, 3, "python api framework question here")], "conv_id long, turn long, text string")
    got = session.session_facts(df).orderBy("fact_no").collect()
    assert [(r.text, r.source_count) for r in got] == [(text, 2), ("python api framework question here", 1)]
    assert got[1].category == "tech_stack"


def test_log_snapshot_recovery(spark, tmp_path):
    root = str(tmp_path / "store")
    assert change_log.load_snapshot(spark, root) is None
    log = [(0, "INSERT", 1, 0, 1.0), (1, "INSERT", 1, 1, 2.0), (2, "CHECKPOINT", 0, -1, None), (3, "UPDATE", 1, 0, 3.0), (4, "DELETE", 1, 1, None), (5, "INSERT", 2, 0, 4.0)]
    df = spark.createDataFrame(log, "seq long, op string, user_id long, vec_id long, value double")
    change_log.save_snapshot(change_log.replay(df.where("seq < 2")).select("user_id", "vec_id", "value"), root)
    got = sorted((r.user_id, r.vec_id, r.value) for r in change_log.recover(spark, root, df).collect())
    assert got == [(1, 0, 3.0), (2, 0, 4.0)]
    assert [r.seq for r in change_log.truncate(df).orderBy("seq").collect()] == [3, 4, 5]
    change_log.save_snapshot(change_log.recover(spark, root, df).select("user_id", "vec_id", "value"), root)
    assert change_log.load_snapshot(spark, root).count() == 2
    assert change_log.quarantine(spark, root, "1") and change_log.load_snapshot(spark, root) is None


def test_glove_skips_bad_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("a 1 2\nb x 2\nzero 0 0\nc 3 4.5\n")
    got = sorted((r.word, r.v) for r in change_log.read_glove(spark, str(tmp_path / "g.txt")).collect())
    assert [w for w, _ in got] == ["a", "c"] and got[0][1] == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and got[1][1] == pytest.approx([0.5547, 0.83205], abs=1e-5)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(int(i % 3), i, float(i), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))]
    schema = "user_id long, event_id long, ts double, embedding array<double>"
    want = sorted((r.event_id, r.event, r.mem_id) for r in remember.conflict_fold(spark.createDataFrame(data, schema)).collect())
    for k in range(3):
        spark.createDataFrame(data[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.conflict_stream(source).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(streams.log_sink(str(tmp_path / "out"))).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.event_id, r.event, r.mem_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_residual_codes_bring_scores_closer(spark):
    from lodestore.operators import search

    corpus = spark.read.parquet(f"{SF}/embeddings.parquet")
    query = list(corpus.where("vec_id = 1").first().embedding)
    coded = search.sq8_encode(corpus)
    basis = search.residual_basis(coded, 16)
    truth = {r.vec_id: r.score for r in search.top_k(corpus, query, 500).collect()}
    plain = search.residual_search(search.with_residual(coded, []).withColumn("residual", F.array(F.lit(0.0))), query, [[0.0] * len(query)], 500).collect()
    better = search.residual_search(search.with_residual(coded, basis), query, basis, 500).collect()
    miss = lambda rows: np.mean([(r.score - truth[r.vec_id]) ** 2 for r in rows])
    assert miss(better) < miss(plain)


def test_every_vector_has_its_chain(spark, tmp_path):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(70, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).tolist()
    data = [(i, i % 3, x) for i, x in enumerate(v)]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    near = {i: {j: float(np.dot(v[i], v[j])) for j in range(70) if j != i and j % 3 == i % 3 and np.dot(v[i], v[j]) >= 0.2} for i in range(70)}
    want = set()
    for seed in range(70):
        seen, frontier, found = {seed}, {seed}, []
        for depth in (1, 2):
            reached = {}
            for i in frontier:
                for j, sim in near[i].items():
                    if j not in seen:
                        reached[j] = max(sim, reached.get(j, 0))
            found += [(-round(min(1, sim * (1 - j % 10 / 20)), 6), j, depth) for j, sim in reached.items()]
            frontier = set(reached)
            seen |= frontier
        want |= {(seed, j, depth, rank) for rank, (_, j, depth) in enumerate(sorted(found)[:10], 1)}
    got = {(r.seed, r.vec_id, r.depth, r["rank"]) for r in catalogue.QUERIES["recall_chain_all"](spark, str(tmp_path)).collect()}
    assert got == want and len({x[0] for x in got}) > 60


@pytest.mark.parametrize("query,edges", [("recall_chain", None), ("recall_chain", (64, 256)), ("recall_chain_all", None), ("recall_chain_all", (64, 1 << 21)), ("recall_chain_all", (0, 0))])
def test_chains_need_no_edge_table(spark, tmp_path, monkeypatch, query, edges):
    """Copies, near copies and rows alone, with lists that hold all edges, some or none, give what a walk over all edges gives."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(230, 8))
    v[40:110] = v[40] + rng.normal(size=(70, 8)) * 0.05
    v[110:120] = v[110]
    v = v / np.linalg.norm(v, axis=1)[:, None]
    label = [None if i % 23 == 0 else 9 if i == 5 else i % 3 // 2 for i in range(230)]
    spark.createDataFrame([(i, label[i], x) for i, x in enumerate(v.tolist())], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    vectors = memories.read(spark, str(tmp_path), "embeddings")
    weight = vectors.select("vec_id", (1 - (F.col("vec_id") % 10) / F.lit(20.0)).alias("weight"))
    seeds = vectors if query == "recall_chain_all" else vectors.where("vec_id % 20 = 0")
    want = memories.recall_chain(memories.neighbour_edges(vectors, 0.2), seeds, 2, weight, 10).collect()
    if edges:
        monkeypatch.setattr(chains, "EDGES", edges)
        monkeypatch.setattr(chains, "PER_ROW", 0)
    monkeypatch.setattr(memories, "neighbour_edges", lambda *a: pytest.fail("all edges were listed"))
    got = catalogue.QUERIES[query](spark, str(tmp_path))
    assert got.dtypes == [("seed", "bigint"), ("vec_id", "bigint"), ("depth", "int"), ("score", "double"), ("rank", "int")]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want} and len(want) > 50


def test_chains_of_repeated_ids(spark, tmp_path):
    v = np.eye(3)[[0, 0, 1, 1, 0]] + 0.3
    rows = [(i, 0, x) for i, x in zip([1, 2, 2, 3, 4], (v / np.linalg.norm(v, axis=1)[:, None]).tolist(), strict=True)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.seed, r.vec_id) for r in catalogue.QUERIES["recall_chain_all"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in range(1, 5) for b in range(1, 5) if a != b}


def test_ngrams_of_all_documents(spark, tmp_path):
    texts = ["Un chat, un CHAT!", "aaaaaa b", "", None, "été-2024 x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for w in {w for t in texts for w in re.findall(T.HASH_TOKEN, (t or "").lower())}:
        f = f"^{w}$"
        want.update([(w, f[i : i + n]) for n in (3, 4, 5) for i in range(len(f) - n + 1)] + [(w, f"#{w}")])
    got = {(r.token, r.gram): r.n for r in catalogue.QUERIES["char_ngrams_documents"](spark, str(tmp_path)).collect()}
    assert got == dict(want)


def test_chain_mode_adds_neighbours(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 4))
    v = v / np.linalg.norm(v, axis=1)[:, None]
    data = [(i % 2, i, i % 3 == 0, v[i].tolist(), float(i), 1) for i in range(60)]
    df = spark.createDataFrame(data, "user_id int, event_id int, mine boolean, embedding array<double>, age_h double, reinforcements int")
    query = [1.0, 0.0, 0.0, 0.0]
    weight = lambda i: max(0.05, 0.5 ** (i / 24))
    want = []
    for user in (0, 1):
        ids = [i for i in range(60) if i % 2 == user]
        final = lambda x: round(min(1, max(0, x)), 6)
        found = {i: final(v[i][0] * weight(i) * (1 + 0.3 * math.log(2) / math.log(11))) for i in ids if i % 3 == 0}
        for seed in sorted(found, key=lambda i: (-found[i], i))[:3]:
            near = sorted((-final(v[seed] @ v[i] * weight(i)), i) for i in ids if i != seed and v[seed] @ v[i] >= 0.55)[:6]
            found = {i: -s for s, i in near} | found
        want += [(user, i) for i in sorted(found, key=lambda i: (-found[i], i))[:6]]
    got = memories.recall(df, query, "chain", 6, filters=F.col("mine")).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.event_id) for r in got] == want and any(not r.mine for r in got)


@pytest.mark.parametrize("gone", [("lodestore/llm", "tests/llm", "corpus_pipeline.py"), ("lodestore/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for part in gone:
        shutil.rmtree(copy / part) if (copy / part).is_dir() else (copy / part).unlink(missing_ok=True)
    told = subprocess.run(
        [sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(ROOT, "")}
    )
    assert not told.returncode, told.stderr
    queries, sql = json.loads(told.stdout.splitlines()[-1])
    assert set(catalogue.QUERIES) <= set(queries) and set(catalogue.ORACLES) <= set(sql) and "pipeline" not in queries
    assert any(q.startswith("op1_") for q in queries) == (copy / "lodestore" / "llm").is_dir()


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "lodestore", "llm")), reason="the pipeline is imported with the subpackage only")
def test_entry_passes_other_errors_on(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(ROOT, "")})
    assert told.returncode and "a_module_that_is_not_there" in told.stderr
