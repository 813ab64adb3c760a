"""The store's life cycle, the log against a plain replay, search in blocks, and the learnt encoder."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.functions import text as T
from lodestore.operators import blocks, consolidate, encoder, memories, remember, search, store, weights
from lodestore.plans import catalogue
from lodestore.sources import change_log, models
from lodestore.streaming import remember as streams

LOG = "seq long, op string, user_id long, vec_id long, value double"


def plain_replay(log):
    """One record after another."""
    rows = {}
    for _, op, user, vec, value in sorted(log):
        key = user, vec
        if op == "INSERT" or op == "UPDATE" and key in rows:
            rows[key] = value
        elif op == "DELETE":
            rows.pop(key, None)
    return {(*k, v) for k, v in rows.items()}


def made_up_log(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["INSERT", "UPDATE", "UPDATE", "DELETE", "CHECKPOINT"] if i % 7 == 0 else ["INSERT", "UPDATE", "DELETE"]), r.randrange(3), r.randrange(12), float(i)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 30, 400])
def test_replay_against_a_plain_one(spark, n):
    log = [(i, op, u, v, x) for i, op, u, v, x in made_up_log(n)]
    df = spark.createDataFrame(log, LOG)
    records = [r for r in log if r[1] != "CHECKPOINT"]
    got = {(r.user_id, r.vec_id, r.value) for r in change_log.replay(df).collect()}
    assert got == plain_replay(records)
    cut = max((s for s, op, *_ in log if op == "CHECKPOINT"), default=-1)
    snapshot = spark.createDataFrame(sorted(plain_replay([r for r in records if r[0] <= cut])), "user_id long, vec_id long, value double")
    assert {(r.user_id, r.vec_id, r.value) for r in change_log.replay(df, snapshot).collect()} == plain_replay(records)
    inserts = df.where("op = 'INSERT'").groupBy("user_id", "vec_id").agg(F.max("seq").alias("seq"))
    assert {(r.user_id, r.vec_id) for r in change_log.compact(inserts, df.where("op = 'DELETE'")).collect()} == {x[:2] for x in plain_replay(records)}


def test_records_without_a_vector_are_skipped(spark):
    df = spark.createDataFrame([(0, "INSERT", 1, 0, None), (1, "INSERT", 1, 1, [1.0]), (2, "UPDATE", 1, 1, None), (3, "INSERT", 1, 2, [1.0]), (4, "DELETE", 1, 2, None)], "seq long, op string, user_id long, vec_id long, embedding array<double>")
    assert [(r.vec_id, r.embedding) for r in change_log.replay(df, vector="embedding").collect()] == [(1, [1.0])]


def test_checkpoints_and_crashes(spark, tmp_path):
    root, log = str(tmp_path / "s"), made_up_log(60, 4)
    df = spark.createDataFrame([r for r in log if r[1] != "CHECKPOINT"], LOG)
    want = plain_replay([r for r in log if r[1] != "CHECKPOINT"])
    left = change_log.checkpoint(df, root).cache()
    assert [(r.op, r.vec_id) for r in left.collect()] == [("CHECKPOINT", -1)] and change_log.has_snapshot(spark, root)
    rows = lambda d: {(r.user_id, r.vec_id, r.value) for r in d.collect()}
    assert rows(change_log.recover(spark, root, left)) == want
    assert change_log.checkpoint(left, root).collect() == left.collect() and len(change_log._versions(spark, root)) == 1  # nothing new
    # a crash in the middle of the next snapshot leaves the one before
    change_log.replay(df).write.parquet(f"{root}/snapshot-2/rows")
    assert rows(change_log.recover(spark, root, left)) == want
    more = left.unionByName(spark.createDataFrame([(1000, "INSERT", 9, 9, 1.0)], LOG))
    change_log.checkpoint(more, root)
    assert rows(change_log.recover(spark, root, left.limit(0))) == want | {(9, 9, 1.0)}
    change_log.save_snapshot(change_log.replay(df), root, {"quantiser": spark.range(3)})
    assert change_log.load_snapshot(spark, root, "quantiser").count() == 3 and change_log.load_snapshot(spark, root, "none") is None
    assert change_log.drop_old_snapshots(spark, root, 1) == 2 and len(change_log._versions(spark, root)) == 1


def test_unreadable_and_newer_snapshots(spark, tmp_path):
    root, log = str(tmp_path / "s"), spark.createDataFrame([(0, "INSERT", 1, 1, 1.0)], LOG)
    change_log.save_snapshot(change_log.replay(log).drop("seq", "op"), root)
    marker = tmp_path / "s" / "snapshot-1" / "COMPLETE"
    (tmp_path / "s" / "snapshot-1" / ".COMPLETE.crc").unlink(missing_ok=True)
    marker.write_text(str(change_log.FORMAT + 1))
    with pytest.raises(RuntimeError):
        change_log.load_snapshot(spark, root)
    assert change_log.recover(spark, root, log).count() == 0 and not change_log.has_snapshot(spark, root)


def test_log_files_end_at_the_first_bad_line(spark, tmp_path):
    lines = ['{"seq":0,"op":"INSERT","user_id":"a","vec_id":0,"embedding":[1.0]}', '{"seq":1,"op":"DELETE","user_id":"a","vec_id":0}', '{"seq":2,"op":"INS', '{"seq":3,"op":"INSERT","user_id":"a","vec_id":1,"embedding":[2.0]}']
    (tmp_path / "log.json").write_text("\n".join(lines))
    assert [r.seq for r in change_log.read_log(spark, str(tmp_path / "log.json")).collect()] == [0, 1]
    (tmp_path / "good.json").write_text("\n".join(lines[:2]))
    assert change_log.read_log(spark, str(tmp_path / "good.json")).count() == 2


def test_ids_go_on_where_the_store_ends(spark):
    held = spark.createDataFrame([(1, 0), (1, 7), (2, 0)], "user_id long, vec_id long")
    new = spark.createDataFrame([(1, 5.0, 50), (1, 4.0, 51), (3, 1.0, 52), (1, 4.0, 49), (2, None, 53)], "user_id long, at double, event_id long")
    got = {r.event_id: (r.user_id, r.vec_id) for r in store.insert(held, new, "at", "event_id").collect()}
    assert got == {49: (1, 8), 51: (1, 9), 50: (1, 10), 52: (3, 0), 53: (2, 1)}
    assert store.numbered(new.limit(0), "user_id", "at", "event_id").count() == 0


def test_updates_of_what_is_there(spark):
    schema = "user_id long, vec_id long, text string, ts double, reinforcements int, bio_weight double, conflict_score double"
    held = spark.createDataFrame([(1, 0, "a", 1.0, 3, 0.2, 0.9), (1, 1, "b", 2.0, 1, 0.5, 0.5)], schema)
    changes = spark.createDataFrame([(1, 0, "z", 9.0), (1, 5, "x", 9.0), (1, 1, None, 9.0)], "user_id long, vec_id long, text string, ts double")
    got = sorted(tuple(r) for r in store.update(held, changes).collect())
    assert got == [(1, 0, "z", 1.0, 3, 1.0, 0.0), (1, 1, "b", 2.0, 1, 1.0, 0.0)]
    hits = spark.createDataFrame([(1, 0), (1, 0), (4, 4)], "user_id long, vec_id long")
    assert sorted((r.vec_id, r.reinforcements, r.ts) for r in store.reinforce(held, hits, 7.0).collect()) == [(0, 5, 7.0), (1, 1, 2.0)]
    scores = spark.createDataFrame([(1, 0, 3.0), (1, 1, -1.0)], "user_id long, vec_id long, score double")
    assert sorted((r.vec_id, r.conflict_score) for r in store.with_conflict(held, scores).collect()) == [(0, 1.0), (1, 0.0)]


def test_triggers():
    t = store.Triggers(quantise=True)
    assert t.after(99, 99) == [] and t.after(1, 100) == ["quantise", "checkpoint"] and t.after(450, 500) == ["consolidate", "checkpoint"] and t.after(0, 500) == []
    assert store.Triggers(0, 0).after(10_000, 10) == []


def test_pending_deletions(spark):
    gone = spark.createDataFrame([(1,)] * 5 + [(2,)] * 2, "user_id long")
    assert [(r.user_id, r.pending) for r in store.to_compact(gone, 3).collect()] == [(1, 5)]


def test_sizes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (2, 0)], "user_id long, vec_id long")
    rows.write.parquet(str(tmp_path / "s"))
    r = store.stats(rows, 8, str(tmp_path / "none"), str(tmp_path / "s"), True, 4).first()
    assert (r.users, r.total_vectors, r.dim, r.wal_size_bytes, r.quantization, r.consolidation_cycle) == (2, 2, 8, 0, "SQ8", 4) and r.storage_size_bytes > 0


def test_archived_at_once_keep_the_newest():
    s = remember.Store()
    for i in range(5):
        s.vectors[i], s.reinforcements[i] = np.array([math.cos(i * 0.01), math.sin(i * 0.01)]), 1
    s.next = 5
    event, number, gone, _ = s.remember(np.array([0.8, 0.6]), 1.0, reinforce=2.0, conflict=0.5)
    assert (event, number, gone) == ("conflict", 5, [0, 1, 2, 3, 4]) and [i for _, i in s.archived] == [4, 3, 2]
    assert streams.unpack(streams.pack(s)).archived == s.archived and list(streams.unpack(streams.pack(s)).vectors) == [5]


def test_archived_and_conflicts_of_a_log(spark):
    e = [[1.0, 0.0], [0.8, 0.6], [0.28, 0.96], [0.28, 0.96], [-0.5, 0.8]]
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate(e)], "user_id long, event_id long, ts double, embedding array<double>")
    log = remember.conflict_fold(df)
    assert sorted((r.mem_id, r.archived_by) for r in remember.archived_memories(log, keep=2).collect()) == [(1, 2), (2, 4)]
    got = [(r.event_id, r.event, r.similarity) for r in remember.conflict_log(log, 1).orderBy("event_id").collect()]
    assert got == [(1, "conflict", 0.8), (2, "conflict", 0.8), (3, "reinforced", 1.0), (4, "conflict", 0.628)] and remember.conflict_log(log, 2).count() == 0


def brute(corpus, queries, k, threshold=None):
    out = set()
    for q, v in queries:
        found = sorted((-float(np.dot(v, x)), i) for i, x in corpus)
        found = [(s, i) for s, i in found if threshold is None or -s >= threshold][:k]
        out |= {(q, i, rank) for rank, (_, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("broadcast", "threshold"), [(4096, None), (4096, 0.3), (4, None), (4, 0.3)])
def test_search_in_blocks(spark, monkeypatch, broadcast, threshold):
    """Ties go to the lower id; odd vectors match nothing; many queries are dealt to cells."""
    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(blocks, "CELL", 20)
    monkeypatch.setattr(blocks, "STRIP", 7)
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, size=(15, 4)).astype(float)
    corpus = [(i, base[i % 15].tolist()) for i in range(90)]
    odd = [(90, None), (91, [1.0]), (None, [1.0] * 4), (92, [])]
    queries = [(100 + j, base[j].tolist()) for j in range(11)]
    df = spark.createDataFrame(corpus + odd, "vec_id long, embedding array<float>")
    qs = spark.createDataFrame(queries + [(None, [1.0] * 4), (300, None)], "query_id long, qv array<double>")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in search.batch_top_k(df, qs, 6, threshold).collect()}
    assert got == brute(corpus, queries, 6, threshold)
    assert search.batch_top_k(df, qs.limit(0), 6).count() == 0 and search.batch_top_k(df.limit(0), qs, 6).count() == 0


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 6)
    monkeypatch.setattr(blocks, "STRIP", 4)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(60)] + [(60, 0, None)], "vec_id long, label int, embedding array<double>")
    want = {(i % 2, i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and v[i] @ v[j] >= 0.4}
    assert {(r.label, r.a, r.b) for r in consolidate.merge_pairs(df, 0.4).collect()} == want and want
    near = memories.neighbour_edges(df, 0.4, most=2).collect()
    for i in range(60):
        best = sorted((-(v[i] @ v[j]), j) for j in range(60) if j != i and i % 2 == j % 2 and v[i] @ v[j] >= 0.4)[:2]
        assert sorted(r.dst for r in near if r.src == i) == sorted(j for _, j in best)


def test_factored_products(spark):
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    coded, query = search.sq8_encode(df), [0.5, -1.0, 2.0, 0.0, 1.0, 3.0]
    decoded = {r.vec_id: sum(q * (c * s + o) for q, c, s, o in zip(query, r.code, r.scale, r.offset, strict=True)) for r in coded.collect()}
    got = search.sq8_search(coded, query, 40).collect()
    assert all(r.score == pytest.approx(decoded[r.vec_id]) for r in got) and len(got) == 40
    assert "code" in search.quantise_from(df, 40).columns and "code" not in search.quantise_from(df, 41).columns


TEXTS = ["red apple pie", "green apple tart", "red wine", "engine oil and wheels", "wheels of an engine", None, "", "qqq"]


def test_encoder_against_a_whole_decomposition(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = encoder.fit(docs, 3, rounds=12)
    entries = encoder.entries(docs, model.columns.select("token", "df"), model.n_docs).collect()
    idx = {r.token: (r.idx, r.column) for r in model.columns.collect()}
    assert sorted(i for i, _ in idx.values()) == list(range(len(idx)))
    x = np.zeros((len(TEXTS), len(idx)))
    for r in entries:
        x[r.doc_id, idx[r.token][0]] = r.w
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert model.singular_values == pytest.approx(s[:3].tolist(), abs=1e-6)
    columns = np.zeros((3, len(idx)))
    for i, c in idx.values():
        columns[:, i] = c
    assert np.abs(np.abs(columns @ vt[:3].T) - np.eye(3)).max() < 1e-5
    got = {r.doc_id: np.array(r.embedding) for r in encoder.transform(model, docs).collect()}
    for i in range(len(TEXTS)):
        want = columns @ x[i]
        want = want / np.linalg.norm(want) if np.linalg.norm(want) > 1e-9 else None
        if want is not None:
            assert got[i] == pytest.approx(want, abs=1e-6)
    assert got[5] == pytest.approx(encoder.direction(encoder.UNKNOWN, 3)) and len(got) == len(TEXTS)


def test_encoder_moves_no_vector_with_an_entry(spark, monkeypatch):
    made = []
    monkeypatch.setattr(encoder, "entries", lambda *a, **b: made.append(a))
    monkeypatch.setattr(weights, "SLICE", 2)
    rows = [("copy" if i == 3 else str(i), t) for i, t in enumerate(TEXTS)] + [("copy", "red apple"), (None, "green wine")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    model, vectors = encoder.fit_transform(docs, 3, rounds=1)
    by = lambda df: sorted((str(r.doc_id), [round(x, 9) + 0.0 for x in r.embedding]) for r in df.collect())
    assert not made and len(by(vectors)) == 10
    for (a, x), (b, y) in zip(by(vectors), by(encoder.transform(model, docs)), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-6)


def test_encoder_grows_and_is_saved(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = encoder.fit(docs.where("doc_id < 5"), 3)
    grown = encoder.partial_fit(model, spark.createDataFrame([(9, "purple apple")], "doc_id long, text string"))
    old, new = ({r.token: r for r in m.columns.collect()} for m in (model, grown))
    assert set(new) - set(old) == {"purple"} and new["purple"].idx == len(old) and new["apple"].df == old["apple"].df + 1 and grown.n_docs == 6
    assert all(new[t].idx == old[t].idx and new[t].column == old[t].column for t in old)
    assert np.array(new["purple"].column) == pytest.approx(encoder.direction("purple", 3) * model.scale)
    encoder.save(grown, str(tmp_path / "m"))
    again = encoder.load(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame([(0, "purple apple"), (1, "wheels")], "doc_id long, text string")
    vectors = lambda m: {r.doc_id: r.embedding for r in encoder.transform(m, asked).collect()}
    assert vectors(again) == vectors(grown)


def test_flat_store(spark, tmp_path):
    events = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "key long, text string")
    flat = encoder.FlatStore().add(events, "a").add(events.where("key = 3"), "b")
    assert [(r.key, r["rank"]) for r in flat.recall("red apple pie", "a").collect()] == [(0, 1)]
    assert flat.recall("red apple pie", "b").count() == 0 and flat.recall("engine oil and wheels", "b").first().key == 3
    flat.save(str(tmp_path / "f"))
    again = encoder.FlatStore.load(spark, str(tmp_path / "f"))
    assert again.rows.count() == flat.rows.count() and flat.clear().rows is None
    with pytest.raises(ValueError):
        flat.clear().recall("x", "a")
    model = encoder.fit(events.withColumnRenamed("key", "doc_id"), 4)
    learnt = encoder.FlatStore(model=model).add(events, 1)
    assert learnt.recall("wheels engine", 1, 2, 0.5).first().key in (3, 4)
    learnt.save(str(tmp_path / "g"))
    assert encoder.FlatStore.load(spark, str(tmp_path / "g"), True).recall("wheels engine", 1, 2, 0.5).count() == learnt.recall("wheels engine", 1, 2, 0.5).count()


def test_hashed_search_against_plain_vectors(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "apple pie"), (1, "engine")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    corpus = [(i, T.hash_vector(t).astype(float)) for i, t in docs]
    want = brute(corpus, [(0, T.hash_vector("apple pie").astype(float)), (1, T.hash_vector("engine").astype(float))], 5)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in catalogue.QUERIES["hash_embed_topk"](spark, str(tmp_path)).collect()} == want


def test_events_as_tokens_and_text(spark):
    row = (1, "Viewed Pricing", {"plan": "The Pro", "type": "Click_Here", "event": "two words", "timestamp": "2024", "__status__": "active", "reinforcements": "3", "none": None})
    df = spark.createDataFrame([row, (2, None, None), (3, "", {})], "i int, action string, metadata map<string,string>")
    got = {r.i: (r.t, r.x) for r in df.select("i", T.event_tokens(F.col("action"), F.col("metadata")).alias("t"), T.event_text(F.col("action"), F.col("metadata")).alias("x")).collect()}
    assert sorted(got[1][0]) == sorted(["viewed", "pricing", "pro", "click_here", "two", "words", "active"]) and got[2] == ([], "")
    assert sorted(got[1][1].split()) == sorted("Viewed Pricing The Pro Click_Here two words 2024".replace(" 2024", "").split()) and got[3][1] == ""


def test_tables_without_rows(spark, tmp_path):
    """Queries with a query vector give no rows where there are no vectors."""
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("user_topk", "exact_topk", "batch_topk", "topk_per_label", "recall_contextual", "bio_weights", "merge_pairs", "sq8_search", "neighbour_graph"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0, name
    events.limit(0).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert catalogue.QUERIES["dense_ids"](spark, str(tmp_path)).count() == 0 and catalogue.QUERIES["insert_counter"](spark, str(tmp_path)).count() == 0


def test_context_text(spark):
    df = spark.createDataFrame([(1, k, 0.5 * 10**k, "t" * 30) for k in range(1, 5)], "user_id int, rank int, age_h double, text string")
    r = memories.context_text(df, 110).first()
    assert r.context == "## User Memory Context — 1\n- [5.0h ago] " + "t" * 30 + "\n\n(based on 4 memories, ranked by relevance × recency × frequency)" and r.n_lines == 1


def test_numbers_of_a_frequent_start(spark):
    df = spark.createDataFrame([(t,) for t in ["thx", "tha", "b", "éa", "thab", "a", "tha"]], "token string")
    assert {r.token: r.idx for r in T.vocabulary(df).collect()} == {t: i for i, t in enumerate(["a", "b", "tha", "thab", "thx", "éa"])}


def test_other_files(spark, tmp_path):
    rows = spark.createDataFrame([("flat", 1.5)], "config string, ms double")
    change_log.write_benchmark_csv(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in change_log.read_benchmark_csv(spark, str(tmp_path / "c")).collect()] == [("flat", "1.5")]
    assert change_log.read_benchmark_csv(spark, str(tmp_path / "c")).columns[0] == "engine"
    v = np.array([r.embedding for r in change_log.gaussian_vectors(spark, 500, 4).collect()])
    assert np.linalg.norm(v, axis=1) == pytest.approx(np.ones(500)) and np.abs(v.mean(axis=0)).max() < 0.1
    assert {tuple(r.embedding) for r in change_log.gaussian_vectors(spark, 5, 4).collect()} == {tuple(r.embedding) for r in change_log.gaussian_vectors(spark, 5, 4).collect()}


def test_small_models(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0, -float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    model = search.sq8_model(df)
    models.save_quantiser(model, str(tmp_path / "q"), [[1.0, 0.0, 0.0]])
    got, want = models.load_quantiser(spark, str(tmp_path / "q")).first(), model.first()
    assert (got.scale, got.offset, got.basis) == (want.scale, want.offset, [[1.0, 0.0, 0.0]])
    assert models.load_hashing(spark, str(tmp_path / "h")) == {"dim": 256, "low": 3, "high": 5}
    models.save_hashing(spark, str(tmp_path / "h"), 64)
    assert T.hash_vector("a chat", **models.load_hashing(spark, str(tmp_path / "h"))).shape == (64,)
    models.save_edges(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, sim double"), str(tmp_path / "e"))
    spark.createDataFrame([(1, [2, 3])], "src long, neighbours array<long>").write.parquet(str(tmp_path / "old"))
    assert models.load_edges(spark, str(tmp_path / "e")).columns == ["src", "dst", "sim"]
    assert sorted(tuple(r) for r in models.load_edges(spark, str(tmp_path / "old")).collect()) == [(1, 2), (1, 3)]


def test_rows_as_they_are_written(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], None), (2, [0.0, 0.0], 5.0)], "vec_id long, embedding array<double>, ts double")
    got = {r.vec_id: r for r in store.with_defaults(df, 9.0).collect()}
    assert (got[1].status, got[1].ts, got[1].reinforcements, got[1].bio_weight, got[1].conflict_score) == ("active", 9.0, 1, 1.0, 0.0)
    assert got[1].embedding == pytest.approx([0.6, 0.8]) and (got[2].ts, got[2].embedding) == (5.0, [0.0, 0.0])


def test_state_that_a_log_leaves(spark):
    e = [[1.0, 0.0], [1.0, 0.001], [0.8, 0.6], [0.28, 0.96], [0.28, 0.96], [-0.5, 0.866]]
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate(e)], "user_id long, event_id long, ts double, embedding array<double>")
    got = {r.mem_id: (r.event_id, r.reinforcements, r.last_reinforced, r.status) for r in remember.memory_state(remember.conflict_fold(df), keep=1).collect()}
    assert got == {0: (0, 2, 1.0, "deleted"), 1: (2, 1, None, "deleted"), 2: (3, 2, 4.0, "archived"), 3: (5, 1, None, "active")}


def test_quarantine_moves_the_log_too(spark, tmp_path):
    log = spark.createDataFrame([(0, "INSERT", 1, 1, 1.0)], LOG)
    change_log.append(log, str(tmp_path / "log"))
    change_log.append(log.withColumn("seq", F.col("seq") + 1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    (tmp_path / "s" / "snapshot-3").mkdir(parents=True)
    (tmp_path / "s" / "snapshot-3" / "COMPLETE").write_text("1")
    assert change_log.load_snapshot(spark, str(tmp_path / "s")) is None  # no rows were saved
    (tmp_path / "s" / "snapshot-3" / "COMPLETE").write_text("x")
    assert change_log.recover(spark, str(tmp_path / "s"), log, str(tmp_path / "log")).count() == 0
    assert not (tmp_path / "log").exists() and not (tmp_path / "s").exists()


def test_activity_of_a_stream_leaves_late_rows_out(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    batches = [[(at(0.1), "click", 1.0), (at(0.2), "click", 2.0), (at(5.0), "view", 1.0)], [(at(5.5), "view", 4.0), (at(9.0), "view", 1.0)], [(at(0.3), "click", 9.0), (at(12.0), "click", 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streams.activity(source).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.table("activity").collect()}
    assert got[at(0), "click"] == (2, 3.0) and got[at(5), "view"] == (2, 5.0)
