"""Queries of the store's life cycle, of recall with its filters and feedback, of events as text, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import decay
from lodestore.functions import text as T
from lodestore.operators import blocks, consolidate, encoder, memories, remember, search, store
from lodestore.operators.memories import read
from lodestore.plans.catalogue import BOOST, EXP, FINAL, HUMAN, LAST, LOGSQL, MEM, STATUS, TOKENS, op_log, query, top_sql
from lodestore.sources import change_log

AGE = "CASE WHEN age_h < 1 THEN floor(age_h * 60)::BIGINT || 'm ago' WHEN age_h < 24 THEN printf('%.1fh ago', age_h) WHEN age_h < 168 THEN printf('%.1fd ago', age_h / 24) ELSE printf('%.1fw ago', age_h / 168) END"


# ------------------------------------------------------------ vectors of any length


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 6)
    SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(v, qv) AS s FROM e, q) ORDER BY s DESC, vec_id LIMIT 10""")
def unscaled_topk(spark, sf_dir):
    """Vectors of any length are made unit length as they are written, so products are cosines."""
    scaled = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("embedding"))
    written = store.normalized(scaled)
    found = written.where("vec_id = 6").select("embedding").first()
    return search.top_k(written, list(found[0]) if found else [], 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], qv) AS s FROM embeddings, q)
    SELECT vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 3 AND s >= 0.7""")
def similarity_search(spark, sf_dir):
    """The index's own defaults: three results, threshold 0.7."""
    found = search.similarity_search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), memories.query_vector(spark, sf_dir))
    return found.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT src, dst, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE sim >= 0.1) WHERE r <= 8""")
def neighbour_graph(spark, sf_dir):
    """Each vector's eight nearest of its label."""
    return blocks.neighbour_graph(read(spark, sf_dir, "embeddings"), 0.1, 8).select("src", "dst", F.round("sim", 6).alias("sim"))


# ------------------------------------------------------------ inserts, deletions, checkpoints

HALF = "(SELECT median(event_id) FROM events)"


@query(f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id > {HALF}, ts, event_id) - 1 AS mem_id, event_id > {HALF} AS new FROM events")
def insert_counter(spark, sf_dir):
    """The later half of the events, inserted into a store of the earlier half: ids go on where each user's end."""
    events = read(spark, sf_dir, "events").withColumn("at", memories.seconds(F.col("ts")))
    half = events.agg(F.percentile("event_id", F.lit(0.5))).first()[0] or 0
    stored = store.numbered(events.where(F.col("event_id") <= half), "user_id", "at", "event_id", "vec_id")
    added = store.insert(stored.select("user_id", "vec_id"), events.where(F.col("event_id") > half), "at", "event_id")
    both = stored.withColumn("new", F.lit(False)).unionByName(added.withColumn("new", F.lit(True)))
    return both.select("user_id", "event_id", F.col("vec_id").alias("mem_id"), "new")


@query(f"""WITH {LOGSQL}, {LAST}, gone AS (SELECT DISTINCT user_id, vec_id FROM log WHERE vec_id % 4 = 0)
    SELECT user_id, count(*) AS before, count(*) FILTER (vec_id % 4 = 0) AS forgotten, count(*) FILTER (vec_id % 4 <> 0) AS left FROM last GROUP BY user_id""".replace("AS left", "AS remaining"))
def forget(spark, sf_dir):
    """Single memories deleted by key: how many were there, and what remains."""
    rows = change_log.replay(op_log(spark, sf_dir))
    keys = op_log(spark, sf_dir).where("vec_id % 4 = 0 and op <> 'CHECKPOINT'").select("user_id", "vec_id")
    count = lambda df, name: df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    out = count(rows, "before").join(count(store.existing(rows, keys), "forgotten"), "user_id", "left").join(count(store.forget(rows, keys), "remaining"), "user_id", "left")
    return out.select("user_id", "before", F.coalesce("forgotten", F.lit(0)).alias("forgotten"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


@query("""SELECT user_id, count(*) AS n, user_id % 3 = 0 AS purged FROM events GROUP BY user_id""")
def purge_user(spark, sf_dir):
    """Every third user's memories go, archived ones included: the counts deleted and left."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id")
    left, deleted = store.purge(rows, rows.where("user_id % 3 = 0"))
    kept = left.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("purged", F.lit(False))
    return kept.unionByName(deleted.select("user_id", F.col("deleted").alias("n"), F.lit(True).alias("purged")))


@query(f"WITH {LOGSQL}, {LAST} SELECT user_id, vec_id, value FROM last")
def checkpoint_cycle(spark, sf_dir):
    """The rows after a crash: a snapshot of the log up to its last checkpoint, and the records after it."""
    log = op_log(spark, sf_dir)
    cut = change_log.last_checkpoint(log)
    snapshot = change_log.replay(log.where(F.col("seq") <= cut)).select("user_id", "vec_id", "value")
    return change_log.replay(log, snapshot).select("user_id", "vec_id", "value")


@query(f"WITH {LOGSQL} SELECT max(seq) + 1 AS seq, 'CHECKPOINT' AS op, -1::BIGINT AS vec_id, (SELECT count(*) FROM log WHERE seq > (SELECT max(seq) FROM log WHERE op = 'CHECKPOINT')) AS kept FROM log")
def checkpoint_record(spark, sf_dir):
    """The record that a checkpoint appends, and how many records a truncation keeps before."""
    log = op_log(spark, sf_dir)
    kept = change_log.truncate(log).agg(F.count(F.lit(1)).alias("kept"))
    return change_log.checkpoint_record(log).select("seq", "op", "vec_id").crossJoin(F.broadcast(kept))


# ------------------------------------------------------------ recall with status, feedback, listings

FILTERED = f"{STATUS} = 'archived' AND event_type = 'error' AND age_h <= 400"


def _with_status(spark, sf_dir):
    rows = memories.memories(spark, sf_dir)
    return rows.withColumn("status", F.when(F.col("event_type") == "error", "archived").otherwise("active")).withColumn("category", F.col("event_type"))


def _ranked_sql(score: str, where: str, least: float = 0.0) -> str:
    return f"WITH {MEM} " + top_sql(f"SELECT * FROM (SELECT *, {FINAL(score)} AS score FROM scored WHERE {where}) WHERE score >= {least}", "score", 5)


CONTEXTUAL = f"cosine * {EXP(24.0, 0.05)} * {BOOST}"


@query(_ranked_sql(CONTEXTUAL, f"{STATUS} = 'active'", 0.002))
def recall_status(spark, sf_dir):
    """Archived memories are not recalled; a least score applies."""
    found = memories.recall(_with_status(spark, sf_dir), memories.query_vector(spark, sf_dir), "contextual", 5, 0.002)
    return found.select("user_id", "event_id", "score", "rank")


@query(_ranked_sql(CONTEXTUAL, FILTERED))
def recall_archived(spark, sf_dir):
    """Archived memories of a category and an age, asked for by their status."""
    found = memories.recall(_with_status(spark, sf_dir), memories.query_vector(spark, sf_dir), "contextual", 5, status="archived", category="error", max_age_hours=400)
    return found.select("user_id", "event_id", "score", "rank")


@query(_ranked_sql(CONTEXTUAL, "true"))
def recall_summary(spark, sf_dir):
    return memories.recall(_with_status(spark, sf_dir), memories.query_vector(spark, sf_dir), "summary", 5, status="all").select("user_id", "event_id", "score", "rank")


@query(f"""WITH {MEM}, found AS ({top_sql(f"SELECT * FROM (SELECT *, {FINAL(CONTEXTUAL)} AS score FROM scored WHERE {STATUS} = 'active') WHERE score >= 0", 'score', 5)})
    SELECT m.user_id, m.event_id, m.reinforcements + (f.event_id IS NOT NULL)::INT AS reinforcements, (f.event_id IS NOT NULL)::INT AS recall_count, CASE WHEN f.event_id IS NOT NULL THEN 0.0::DOUBLE END AS recalled_h
    FROM mem m LEFT JOIN found f ON f.user_id = m.user_id AND f.event_id = m.event_id""")
def recall_feedback(spark, sf_dir):
    """What a recall leaves behind: counters and times of the memories that it returned."""
    rows = _with_status(spark, sf_dir)
    found = memories.recall(rows, memories.query_vector(spark, sf_dir), "contextual", 5)
    return memories.feedback(rows, found).select("user_id", "event_id", "reinforcements", "recall_count", "recalled_h")


@query("SELECT user_id, event_id FROM events WHERE event_type = 'error'")
def archived_list(spark, sf_dir):
    return store.archived(_with_status(spark, sf_dir)).select("user_id", "event_id")


@query()
def conflict_log(spark, sf_dir):
    """Reinforcements and conflicts of all users, with the similarity that decided."""
    rows = memories.memories(spark, sf_dir).withColumn("ts", memories.seconds(F.col("ts")))
    return remember.conflict_log(remember.conflict_fold(rows)).select("user_id", "event_id", "event", "mem_id", "similarity")


@query()
def memory_state(spark, sf_dir):
    """Every memory that the events left: its reinforcements, when the last came, and its status."""
    rows = memories.memories(spark, sf_dir).withColumn("ts", memories.seconds(F.col("ts")))
    return remember.memory_state(remember.conflict_fold(rows))


@query(f"""WITH {MEM}, r AS (SELECT *, 'value ' || event_id AS text, event_type AS action, cosine * {EXP(24.0, 0.05)} * {BOOST} AS s FROM scored)
    SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN text ELSE action END AS text, action, round(s, 6) AS score, reinforcements, round(age_h, 2) AS hours_ago FROM r ORDER BY s DESC, event_id LIMIT 20""")
def api_results(spark, sf_dir):
    """The shape of answers: the text, or the action where there is none."""
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir))
    rows = rows.withColumn("score", F.col("cosine") * decay.exponential(F.col("age_h")) * decay.freq_boost(F.col("reinforcements"))).withColumn("action", F.col("event_type"))
    rows = rows.withColumn("text", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("value "), F.col("event_id").cast("string"))))
    return store.api_results(rows.orderBy(F.desc("score"), "event_id").limit(20))


@query(f"""WITH {MEM}, p AS (SELECT *, {EXP(24.0, 0.05)} AS w, {BOOST} AS b FROM scored)
    SELECT event_id, 'Score breakdown:' || chr(10) || printf('  Cosine similarity : %.4f', cosine) || chr(10) || printf('  Temporal decay    : %.4f  (%.1fh ago)', w, age_h) || chr(10)
      || printf('  Frequency boost   : %.4f  (%d reinforcements)', b, reinforcements) || chr(10) || '  ' || repeat('─', 29) || chr(10) || printf('  Final score       : %.4f', cosine * w * b) AS explanation FROM p""")
def explain_score(spark, sf_dir):
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir))
    w, b = decay.exponential(F.col("age_h")), decay.freq_boost(F.col("reinforcements"))
    return rows.select("event_id", decay.explained(F.col("cosine"), w, b, F.col("reinforcements"), F.col("age_h"), F.col("cosine") * w * b).alias("explanation"))


@query(f"""WITH {MEM}, s AS (SELECT user_id, event_id, age_h, {FINAL(CONTEXTUAL)} AS score, event_type || ' ' || event_id AS text FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s),
    l AS (SELECT user_id, rank, '- [' || {AGE} || '] ' || text AS line, '## User Memory Context — ' || user_id AS header FROM r WHERE rank <= 20),
    u AS (SELECT *, length(header) + sum(length(line)) OVER (PARTITION BY user_id ORDER BY rank) <= 160 AS fits, count(*) OVER (PARTITION BY user_id) AS n FROM l)
    SELECT user_id, any_value(header) || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY rank) FILTER (fits), '') || chr(10) || chr(10) || '(based on ' || any_value(n) || ' memories, ranked by relevance × recency × frequency)' AS context,
      (count(*) FILTER (fits))::INTEGER AS n_lines FROM u GROUP BY user_id""")
def context_texts(spark, sf_dir):
    """Each user's memories as the text of a prompt, in 160 characters."""
    found = memories.recall(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir), "contextual", 20, min_score=-1.0)
    return memories.context_text(found.withColumn("text", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))), 160)


SCENARIOS = {"newer": f"cosine * {HUMAN}", "reinforced": f"cosine * {BOOST}", "combined": f"cosine * {HUMAN} * {BOOST}"}


@query(f"""WITH {MEM}, g AS (SELECT *, max(ts_s * 1e7 + event_id) OVER (PARTITION BY user_id, vec_id) AS newest FROM scored WHERE cosine > 0),
    """ + ", ".join(f"{name} AS (SELECT user_id, vec_id, event_id = arg_max(event_id, (score, -event_id)) OVER (PARTITION BY user_id, vec_id) AS top, ts_s * 1e7 + event_id = newest AS truth FROM (SELECT *, {score} AS score FROM g))" for name, score in SCENARIOS.items())
    + " " + " UNION ALL ".join(f"SELECT '{name}' AS scenario, round(avg(truth::INT), 6) AS recall_at_1, count(*) AS trials FROM {name} WHERE top" for name in SCENARIOS))
def temporal_recall_at_1(spark, sf_dir):
    """How often the newest memory of a user and a vector comes first, by the signals that rank."""
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir)).where("cosine > 0").withColumn("at", memories.seconds(F.col("ts")))
    human, boost = decay.preset("human", F.col("age_h")), decay.freq_boost(F.col("reinforcements"))
    scores = {"newer": F.col("cosine") * human, "reinforced": F.col("cosine") * boost, "combined": F.col("cosine") * human * boost}
    out = None
    for name, score in scores.items():
        top = rows.withColumn("score", score).groupBy("user_id", "vec_id").agg(
            F.max_by("event_id", F.struct("score", -F.col("event_id"))).alias("top"), F.max_by("event_id", F.struct("at", "event_id")).alias("truth")
        )
        one = top.agg(F.round(F.avg((F.col("top") == F.col("truth")).cast("int")), 6).alias("recall_at_1"), F.count(F.lit(1)).alias("trials")).select(F.lit(name).alias("scenario"), "recall_at_1", "trials")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ consolidation

BIO_SQL = """w AS (SELECT *, exp(-age_h / 48.0::DOUBLE) * (1 + 0.5::DOUBLE * reinforcements) AS raw FROM mem),
    b AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY user_id) > 0 THEN raw / max(raw) OVER (PARTITION BY user_id) ELSE 0 END AS weight FROM w)"""


@query(f"""WITH {MEM}, {BIO_SQL}, few AS (SELECT user_id, vec_id, count(*) AS n FROM b WHERE NOT (weight < 0.05 AND age_h > 24) AND reinforcements <= 2 GROUP BY 1, 2),
    m AS (SELECT user_id, least(50, count(*) FILTER (n > 1)) AS merged FROM few GROUP BY user_id)
    SELECT b.user_id, count(*) AS weights_updated, count(*) FILTER (weight < 0.05 AND age_h > 24) AS pruned, coalesce(any_value(merged), 0)::BIGINT AS merged FROM b LEFT JOIN m USING (user_id) GROUP BY b.user_id""")
def consolidation_cycle(spark, sf_dir):
    """One cycle's statistics; only memories of one and the same vector are similar enough to be merged here."""
    rows = memories.memories(spark, sf_dir).withColumn("ts", memories.seconds(F.col("ts")))
    return consolidate.cycle(rows)[1].select("user_id", "weights_updated", "pruned", F.col("merged").cast("long").alias("merged"))


@query(f"WITH {MEM}, {BIO_SQL} SELECT event_id, round(greatest(0.0, least(1.0, weight * 1.5 - 0.2)), 6) AS bio_weight FROM b")
def apply_weights(spark, sf_dir):
    """Weights are put into 0..1 as they are applied."""
    rows = memories.memories(spark, sf_dir)
    weights = consolidate.bio_weights(rows).select("event_id", (F.col("weight") * 1.5 - 0.2).alias("weight"))
    return consolidate.apply_weights(rows, weights).select("event_id", F.round("bio_weight", 6).alias("bio_weight"))


# ------------------------------------------------------------ events as text


def _events(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" Of The USER"))).otherwise(F.col("event_type"))
    note = F.concat(F.lit("The plan, was "), (F.col("event_id") % 5).cast("string"), F.lit("!"))
    fields = F.create_map(F.lit("kind"), kind, F.lit("type"), F.col("event_type"), F.lit("timestamp"), F.col("ts").cast("string"), F.lit("note"), note)
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Did_"), "event_type").alias("action"), fields.alias("metadata"))


def _tokens_sql(text: str) -> str:
    return TOKENS.replace("lower(text)", f"lower({text})")


@query(f"""WITH e AS (SELECT event_id, 'Did_' || event_type AS action, CASE WHEN event_id % 3 = 0 THEN event_type || ' Of The USER' ELSE event_type END AS kind, event_type, 'The plan, was ' || event_id % 5 || '!' AS note FROM events),
    t AS (SELECT event_id, list_concat(list_concat([lower(action)], {_tokens_sql('kind')}), list_concat([lower(event_type)], {_tokens_sql('note')})) AS t FROM e)
    SELECT event_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM t""")
def event_tokens(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", T.event_tokens(F.col("action"), F.col("metadata")).alias("t"))
    return rows.select("event_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("""SELECT event_id, 'Did_' || event_type || ' ' || CASE WHEN event_id % 3 = 0 THEN event_type || ' Of The USER' ELSE event_type END || ' ' || event_type || ' The plan, was ' || event_id % 5 || '!' AS text FROM events""")
def event_text(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", T.event_text(F.col("action"), F.col("metadata")).alias("text"))


@query(f"""WITH tok AS (SELECT doc_id, {TOKENS} AS t FROM documents), w AS (SELECT DISTINCT doc_id % 2 AS half, unnest(t) AS token FROM tok),
    a AS (SELECT DISTINCT token FROM w WHERE half = 0), b AS (SELECT DISTINCT token FROM w WHERE half = 1 AND token NOT IN (SELECT token FROM a)),
    d AS (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS token FROM tok) GROUP BY token),
    n AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM a UNION ALL SELECT token, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY token) - 1 FROM b)
    SELECT token, idx, df, round(ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1, 6) AS idf FROM n JOIN d USING (token)""")
def grown_vocabulary(spark, sf_dir):
    """The vocabulary of the even documents after the odd ones came: numbers stay, new tokens follow, frequencies are of all."""
    docs = read(spark, sf_dir, "documents")
    first, more = (T.document_frequency(docs.where(F.col("doc_id") % 2 == k)) for k in (0, 1))
    grown = T.grown_vocabulary(T.vocabulary(first), more)
    return grown.join(T.idf(T.merged_frequency(first, more), docs.count()), "token").select("token", "idx", "df", F.round("idf", 6).alias("idf"))


@query()
def encoder_topk(spark, sf_dir):
    """For each benchmark text the five documents nearest by learnt vectors."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model, vectors = encoder.fit_transform(docs, 32)
    corpus = vectors.select(F.col("doc_id").alias("vec_id"), "embedding")
    asked = encoder.transform(model, read(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("qv"))
    return search.batch_top_k(corpus, asked, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
