"""The named queries of the engine and the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import decay, vector
from lodestore.functions import text as T
from lodestore.operators import consolidate, memories, remember, search, session, store
from lodestore.operators.memories import NOW, read
from lodestore.sources import change_log

QUERIES: dict = {}
ORACLES: dict = {}

MEM = f"""
mem AS (SELECT e.event_id, e.user_id, e.event_type, e.value, b.vec_id, b.label, b.embedding::DOUBLE[] AS v, epoch(e.ts) AS ts_s,
    count(*) OVER (PARTITION BY e.user_id, e.event_type) AS reinforcements, ({NOW} - epoch(e.ts)) / 3600.0 AS age_h
  FROM events e JOIN embeddings b ON b.vec_id = e.event_id % (SELECT count(*) FROM embeddings)),
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
scored AS (SELECT mem.*, list_inner_product(v, qv) AS cosine FROM mem, q)"""
HUMAN = "greatest(0.05, least(1.0, CASE WHEN greatest(age_h, 0) < 1 THEN 1.0 WHEN greatest(age_h, 0) < 24 THEN 0.80 WHEN greatest(age_h, 0) < 168 THEN 0.55 WHEN greatest(age_h, 0) < 720 THEN 0.25 ELSE 0.05 END::DOUBLE))"
STEP = HUMAN.replace("0.80", "0.75").replace("0.55", "0.50").replace("0.25", "0.20")
BOOST = f"least(1 + 0.3 * ln(1 + greatest(reinforcements, 1)) / {math.log(11)!r}, 1.3)"


def EXP(half, floor):  # noqa: N802
    return f"greatest({floor}, least(1.0, exp({-math.log(2) / half!r}::DOUBLE * greatest(age_h, 0))))"


def LIN(half, floor):  # noqa: N802
    return f"greatest({floor}, least(1.0, 1 - greatest(age_h, 0) / {2 * half!r}::DOUBLE))"


def FINAL(x):  # noqa: N802
    return f"round(greatest(0.0, least(1.0, {x})), 6)"


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def top_sql(source: str, score: str, k: int, extra: str = "") -> str:
    """Per user the k best rows."""
    return f"SELECT user_id, event_id, {extra}{score} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {score} DESC, event_id) AS rank FROM ({source})) WHERE rank <= {k}"


@query(f"WITH {MEM} SELECT user_id, event_id, round(score, 6) AS score, rank FROM ({top_sql(f'SELECT *, cosine * {HUMAN} * {BOOST} AS score FROM scored WHERE cosine * {HUMAN} * {BOOST} >= 0.05', 'score', 5)})")
def user_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's five best memories against query vector 0."""
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir))
    rows = rows.withColumn("score", F.col("cosine") * decay.preset("human", F.col("age_h")) * decay.freq_boost(F.col("reinforcements")))
    found = search.ranked(rows.where(F.col("score") >= 0.05), "user_id", 5, "score", "event_id")
    return found.select("user_id", "event_id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------ exact search

Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 10")
def exact_topk(spark, sf_dir):
    found = search.top_k(read(spark, sf_dir, "embeddings"), memories.query_vector(spark, sf_dir), 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings WHERE list_inner_product(embedding::DOUBLE[], {Q0}) >= 0.2 ORDER BY list_inner_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 5")
def exact_topk_threshold(spark, sf_dir):
    found = search.top_k(read(spark, sf_dir, "embeddings"), memories.query_vector(spark, sf_dir), 5, 0.2)
    return found.select("vec_id", F.round("score", 6).alias("score"))


def _queries(spark, sf_dir):
    """Query vectors: every twentieth row."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


BATCH = """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 {where})) WHERE rank <= {k}"""


@query(BATCH.format(where="", k=10))
def batch_topk(spark, sf_dir):
    found = search.batch_top_k(read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(BATCH.format(where="AND list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3", k=5))
def batch_topk_threshold(spark, sf_dir):
    found = search.batch_top_k(read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5, 0.3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT label, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT label, vec_id, list_inner_product(embedding::DOUBLE[], {Q0}) AS s FROM embeddings)) WHERE rank <= 5")
def topk_per_label(spark, sf_dir):
    rows = memories.with_cosine(read(spark, sf_dir, "embeddings"), memories.query_vector(spark, sf_dir))
    return search.ranked(rows, "label", 5, "cosine", "vec_id").select("label", "vec_id", F.round("cosine", 6).alias("score"), "rank")


@query(f"SELECT vec_id, score FROM (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {Q0}), 4) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 20) WHERE score >= 0.25 ORDER BY score DESC, vec_id LIMIT 10")
def engine_search_threshold(spark, sf_dir):
    found = search.engine_search(read(spark, sf_dir, "embeddings"), memories.query_vector(spark, sf_dir), 10, 0.25)
    return found.select("vec_id", "score")


# ------------------------------------------------------------ decay and scores

AGES = f"(SELECT event_id, ({NOW} - epoch(ts)) / 3600.0 AS age_h FROM events)"


def _ages(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", memories.age_hours(F.col("ts")).alias("age_h"))


@query(f"SELECT event_id, round({EXP(24.0, 0.05)}, 6) AS weight FROM {AGES}")
def decay_exponential(spark, sf_dir):
    return _ages(spark, sf_dir).select("event_id", F.round(decay.exponential(F.col("age_h")), 6).alias("weight"))


@query(f"SELECT event_id, round({LIN(168.0, 0.05)}, 6) AS weight FROM {AGES}")
def decay_linear(spark, sf_dir):
    return _ages(spark, sf_dir).select("event_id", F.round(decay.linear(F.col("age_h"), 168.0), 6).alias("weight"))


@query(f"SELECT event_id, {STEP} AS weight FROM {AGES}")
def decay_step(spark, sf_dir):
    return _ages(spark, sf_dir).select("event_id", decay.step(F.col("age_h")).alias("weight"))


@query(f"SELECT event_id, round({EXP(1.0, 0.02)}, 6) AS conversation, round({EXP(168.0, 0.1)}, 6) AS preference, round({LIN(720.0, 0.15)}, 6) AS fact, {HUMAN} AS human FROM {AGES}")
def decay_presets(spark, sf_dir):
    cols = [decay.preset(name, F.col("age_h")) for name in decay.PRESETS]
    return _ages(spark, sf_dir).select("event_id", *[(c if name == "human" else F.round(c, 6)).alias(name) for name, c in zip(decay.PRESETS, cols, strict=True)])


HOURS = (0.0, 0.5, 1.0, 6.0, 24.0, 72.0, 168.0, 720.0, 2000.0)


@query(f"SELECT age_h AS hours, round({EXP(24.0, 0.05)}, 4) AS exponential, round({LIN(24.0, 0.05)}, 4) AS linear, {STEP} AS step FROM (SELECT unnest([{', '.join(map(str, HOURS))}]::DOUBLE[]) AS age_h)")
def decay_preview(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, HOURS))).alias("hours"))
    h = F.col("hours")
    return rows.select("hours", F.round(decay.exponential(h), 4).alias("exponential"), F.round(decay.linear(h), 4).alias("linear"), decay.step(h).alias("step"))


@query(f"SELECT reinforcements, round({BOOST}, 6) AS boost, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY user_id, event_type) AS reinforcements FROM events) GROUP BY ALL")
def freq_boost(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("reinforcements"))
    rows = rows.groupBy("reinforcements").agg(F.sum("reinforcements").alias("n"))
    return rows.select("reinforcements", F.round(decay.freq_boost(F.col("reinforcements")), 6).alias("boost"), "n")


@query(f"WITH {MEM} SELECT event_id, round(cosine * {EXP(24.0, 0.05)} * {BOOST}, 6) AS score FROM scored")
def score_multiplicative(spark, sf_dir):
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir))
    return rows.select("event_id", F.round(F.col("cosine") * decay.exponential(F.col("age_h")) * decay.freq_boost(F.col("reinforcements")), 6).alias("score"))


@query(f"WITH {MEM} SELECT event_id, round(0.6::DOUBLE * cosine + 0.3::DOUBLE * {EXP(24.0, 0.05)} + 0.1::DOUBLE * ({BOOST} - 1) / {decay.MAX_BOOST - 1 + 1e-9!r}::DOUBLE, 6) AS score FROM scored")
def score_weighted(spark, sf_dir):
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir))
    return rows.select("event_id", F.round(decay.weighted(F.col("cosine"), decay.exponential(F.col("age_h")), decay.freq_boost(F.col("reinforcements"))), 6).alias("score"))


@query(f"WITH {MEM}, r AS (SELECT event_id, cosine * {EXP(24.0, 0.05)} * {BOOST} AS s FROM scored) SELECT event_id, round(s, 6) AS score FROM r WHERE s >= 0.01 ORDER BY s DESC, event_id LIMIT 20")
def rank_rerank(spark, sf_dir):
    rows = memories.with_cosine(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir))
    rows = rows.withColumn("s", F.col("cosine") * decay.exponential(F.col("age_h")) * decay.freq_boost(F.col("reinforcements"))).where("s >= 0.01")
    return rows.orderBy(F.desc("s"), "event_id").limit(20).select("event_id", F.round("s", 6).alias("score"))


@query(f"SELECT event_id, CASE WHEN age_h < 1 THEN floor(age_h * 60)::BIGINT || 'm ago' WHEN age_h < 24 THEN printf('%.1fh ago', age_h) WHEN age_h < 168 THEN printf('%.1fd ago', age_h / 24) ELSE printf('%.1fw ago', age_h / 168) END AS age FROM {AGES}")
def age_text(spark, sf_dir):
    return _ages(spark, sf_dir).select("event_id", decay.age_text(F.col("age_h")).alias("age"))


# ------------------------------------------------------------ recall

STATUS = "CASE WHEN event_type = 'error' THEN 'archived' ELSE 'active' END"


@query(f"""WITH {MEM}, near AS (SELECT *, round(cosine, 4) AS c4 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC, event_id) AS r FROM scored) WHERE r <= 30),
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c4 DESC, event_id) AS r2 FROM near WHERE c4 >= 0) WHERE r2 <= 15),
    final AS (SELECT user_id, event_id, c4 * {HUMAN} * {BOOST} AS s FROM cut WHERE {STATUS} = 'active')
    SELECT user_id, event_id, round(s, 8) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS rank FROM final WHERE s >= 0.02) WHERE rank <= 5""")
def manager_recall(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "archived").otherwise("active")
    found = memories.manager_recall(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir), 5, 0.02, status)
    return found.select("user_id", "event_id", F.round("score", 8).alias("score"), "rank")


def _recall_sql(score: str, where: str = "true") -> str:
    return f"WITH {MEM} " + top_sql(f"SELECT * FROM (SELECT *, {FINAL(score)} AS score FROM scored WHERE {where}) WHERE score >= 0", "score", 5)


def _recall(spark, sf_dir, mode, **more):
    found = memories.recall(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir), mode, 5, **more)
    return found.select("user_id", "event_id", "score", "rank")


@query(_recall_sql("cosine"))
def recall_semantic(spark, sf_dir):
    return _recall(spark, sf_dir, "semantic")


@query(_recall_sql(f"cosine * {EXP(24.0, 0.05)}"))
def recall_temporal(spark, sf_dir):
    return _recall(spark, sf_dir, "temporal")


RECENT = "CASE WHEN event_id % 7 = 0 THEN least(1 + 0.15 * exp(-(event_id % 48) / 6.0::DOUBLE), 1.15) ELSE 1.0 END"


@query(_recall_sql(f"cosine * {EXP(24.0, 0.05)} * {BOOST} * {RECENT}"))
def recall_contextual(spark, sf_dir):
    recalls = read(spark, sf_dir, "events").where("event_id % 7 = 0").select("user_id", "event_id", (F.col("event_id") % 48).cast("double").alias("recalled_h"))
    return _recall(spark, sf_dir, "contextual", recalls=recalls)


@query(_recall_sql(f"cosine * {EXP(24.0, 0.05)} * {BOOST}", "event_type = 'click' AND age_h <= 500"))
def recall_filtered(spark, sf_dir):
    return _recall(spark, sf_dir, "contextual", filters=(F.col("event_type") == "click") & (F.col("age_h") <= 500))


@query()
def recall_chain_mode(spark, sf_dir):
    """The clicks of a user and, of all events, the neighbours of the three best of them."""
    return _recall(spark, sf_dir, "chain", filters=F.col("event_type") == "click", chain_sim=0.2)


EDGES = """edges AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2)"""


def _chain_sql(seed_where: str) -> str:
    return f"""WITH {EDGES}, seeds AS (SELECT vec_id AS seed FROM embeddings WHERE {seed_where}),
    h1 AS (SELECT seed, dst AS vec_id, max(sim) AS sim FROM seeds JOIN edges ON src = seed GROUP BY 1, 2),
    h2 AS (SELECT h1.seed, dst AS vec_id, max(e.sim) AS sim FROM h1 JOIN edges e ON e.src = h1.vec_id WHERE dst <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.vec_id = dst) GROUP BY 1, 2),
    allh AS (SELECT *, 1 AS depth FROM h1 UNION ALL SELECT *, 2 FROM h2),
    s AS (SELECT seed, vec_id, depth, {FINAL('sim * (1 - (vec_id % 10) / 20.0::DOUBLE)')} AS score FROM allh)
    SELECT seed, vec_id, depth, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query(_chain_sql("vec_id % 20 = 0"))
def recall_chain(spark, sf_dir):
    """The chains of a stated query set, every twentieth vector, over the edges of all."""
    return memories.similar_chains(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 0.2, 1 - (F.col("vec_id") % 10) / F.lit(20.0), 10)


@query()
def recall_chain_all(spark, sf_dir):
    """The chains of all vectors, not only those of ``recall_chain``."""
    return memories.similar_chains(read(spark, sf_dir, "embeddings"), F.lit(True), 0.2, 1 - (F.col("vec_id") % 10) / F.lit(20.0), 10)


@query(f"""WITH {MEM}, s AS (SELECT user_id, event_id, {FINAL(f'cosine * {EXP(24.0, 0.05)} * {BOOST}')} AS score, '[' || event_type || '] ' || event_id AS line FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s),
    u AS (SELECT *, sum(length(line)) OVER (PARTITION BY user_id ORDER BY rank) AS used FROM r WHERE rank <= 20)
    SELECT user_id, string_agg(line, chr(10) ORDER BY rank) AS context, count(*)::INTEGER AS n_lines FROM u WHERE used <= 120 GROUP BY user_id""")
def context_blocks(spark, sf_dir):
    found = memories.recall(memories.memories(spark, sf_dir), memories.query_vector(spark, sf_dir), "contextual", 20)
    return memories.context_block(found.withColumn("line", F.concat(F.lit("["), "event_type", F.lit("] "), F.col("event_id").cast("string"))), 120)


# ------------------------------------------------------------ consolidation

BIO = """w AS (SELECT *, exp(-age_h / 48.0::DOUBLE) * (1 + 0.5::DOUBLE * reinforcements) AS raw FROM mem),
    b AS (SELECT event_id, user_id, age_h, CASE WHEN max(raw) OVER (PARTITION BY user_id) > 0 THEN raw / max(raw) OVER (PARTITION BY user_id) ELSE 0 END AS weight, v FROM w)"""


@query(f"WITH {MEM}, {BIO} SELECT event_id, round(weight, 6) AS weight, weight < 0.05 AND age_h > 24 AS prune FROM b")
def bio_weights(spark, sf_dir):
    return consolidate.bio_weights(memories.memories(spark, sf_dir)).select("event_id", F.round("weight", 6).alias("weight"), "prune")


@query(f"WITH {MEM}, {BIO} SELECT user_id, count(*) AS pruned FROM b WHERE weight < 0.05 AND age_h > 24 GROUP BY user_id")
def prune_candidates(spark, sf_dir):
    return consolidate.bio_weights(memories.memories(spark, sf_dir)).where("prune").groupBy("user_id").agg(F.count(F.lit(1)).alias("pruned"))


@query(f"WITH {MEM}, {BIO}, d AS (SELECT user_id, event_id, round(1 - CASE WHEN weight < 1 THEN (1 - list_inner_product(v, qv)) * (2 - weight) ELSE 1 - list_inner_product(v, qv) END, 4) AS score FROM b, q) " + top_sql("SELECT * FROM d", "score", 3))
def bio_search(spark, sf_dir):
    rows = memories.with_cosine(consolidate.bio_weights(memories.memories(spark, sf_dir)), memories.query_vector(spark, sf_dir))
    rows = rows.withColumn("score", F.round(1 - vector.bio_distance(1 - F.col("cosine"), F.col("weight")), 4))
    return search.ranked(rows, "user_id", 3, "score", "event_id").select("user_id", "event_id", "score", "rank")


@query("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def merge_pairs(spark, sf_dir):
    return consolidate.merge_pairs(read(spark, sf_dir, "embeddings"), 0.3).select("label", "a", "b", F.round("sim", 6).alias("sim"))


@query("SELECT label, pos - 1 AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def centroids(spark, sf_dir):
    found = consolidate.centroids(read(spark, sf_dir, "embeddings"))
    return found.select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query()
def episodic_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.lit(1).alias("reinforcements"), F.col("vec_id").cast("double").alias("ts"), "embedding")
    return consolidate.episodic_merge(rows, 0.25, 50, "label").select("label", "representative", "merged_from", "reinforcements")


@query()
def conflict_fold(spark, sf_dir):
    rows = memories.memories(spark, sf_dir).withColumn("ts", memories.seconds(F.col("ts")))
    return remember.conflict_fold(rows).select("user_id", "event_id", "event", "mem_id", F.size("archived").alias("n_archived"))


@query(f"""WITH {MEM}, n AS (SELECT user_id, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, event_id DESC) AS r FROM mem) WHERE r = 1),
    s AS (SELECT n.user_id, m.event_id, greatest(0, list_inner_product(m.v, n.v)) AS sim FROM n JOIN mem m ON m.user_id = n.user_id AND m.event_id <> n.event_id AND m.event_type <> 'error')
    SELECT user_id, event_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, event_id) AS r FROM s) WHERE r = 1""")
def conflict_candidates(spark, sf_dir):
    """For each user's newest memory, the active memory that is most like it; errors count as archived."""
    rows = memories.memories(spark, sf_dir).withColumn("ts_s", memories.seconds(F.col("ts"))).select("user_id", "event_id", "event_type", "ts_s", "embedding")
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "embedding"), F.struct("ts_s", "event_id")).alias("new"))
    pairs = rows.where("event_type <> 'error'").join(newest, "user_id").where(F.col("event_id") != F.col("new.event_id"))
    pairs = pairs.withColumn("sim", F.greatest(F.lit(0.0), vector.dot(F.col("embedding"), F.col("new.embedding"))))
    return search.ranked(pairs, "user_id", 1, "sim", "event_id").select("user_id", "event_id", F.round("sim", 6).alias("sim"))


# ------------------------------------------------------------ text

PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TOKENS = f"list_filter(string_split_regex(translate(lower(text), '{PUNCTUATION}', '{' ' * 32}'), '\\s+'), lambda w: length(w) >= 2 AND NOT list_contains({STOPS}, w))"
TOK = f"tok AS (SELECT doc_id, {TOKENS} AS t FROM documents)"
DF = f"{TOK}, df AS (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS token FROM tok) GROUP BY token)"
IDF = f"{DF}, idf AS (SELECT token, df, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1 AS idf FROM df)"


@query(f"WITH {TOK} SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok")
def tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {DF} SELECT token, df FROM df")
def doc_freq(spark, sf_dir):
    return T.document_frequency(read(spark, sf_dir, "documents"))


@query(f"WITH {IDF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return T.idf(T.document_frequency(docs), docs.count()).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DF} SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM df")
def vocabulary(spark, sf_dir):
    return T.vocabulary(T.document_frequency(read(spark, sf_dir, "documents")))


@query(f"WITH {IDF}, c AS (SELECT doc_id, len(t) AS n, token, count(*) AS times FROM (SELECT doc_id, t, unnest(t) AS token FROM tok) GROUP BY ALL) SELECT doc_id, c.token, round(times / n::DOUBLE * idf, 6) AS tfidf FROM c JOIN idf USING (token)")
def tfidf(spark, sf_dir):
    found = T.tfidf(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "token", F.round("tfidf", 6).alias("tfidf"))


NOISE = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.NOISE_WORDS) + "]"
SUBSTANTIAL = f"len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) >= 4 AND len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '' AND NOT list_contains({NOISE}, w))) >= 2"


@query(f"SELECT conv_id, turn, {SUBSTANTIAL} AS kept FROM conversations")
def noise_filter(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_substantial(F.col("text")).alias("kept"))


CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(k)}') THEN '{name}'" for name, k in T.CATEGORIES.items()) + " ELSE 'general' END"


@query(f"SELECT doc_id, {CATEGORY} AS category FROM documents")
def infer_category(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.category(F.col("text")).alias("category"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[0-9a-zàâäéèêëîïôöùûüçñ]+')) AS token FROM benchmark), f AS (SELECT token, '^' || token || '$' AS f FROM w)
    SELECT token, gram, count(*) AS n FROM (
      SELECT token, substring(f, i, n) AS gram FROM (SELECT token, f, n, unnest(range(1, length(f) - n + 2)) AS i FROM f, (VALUES (3), (4), (5)) AS k(n))
      UNION ALL SELECT token, '#' || token FROM f) GROUP BY ALL""")
def char_ngrams(spark, sf_dir):
    found = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.HASH_TOKEN), F.lit(0))).alias("token")).distinct()
    return found.select("token", F.explode(T.char_ngrams(F.col("token"))).alias("gram")).groupBy("token", "gram").agg(F.count(F.lit(1)).alias("n"))


@query()
def char_ngrams_documents(spark, sf_dir):
    """The n-grams of the distinct tokens of the documents."""
    found = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.HASH_TOKEN), F.lit(0))).alias("token")).distinct()
    return found.select("token", F.explode(T.char_ngrams(F.col("token"))).alias("gram")).groupBy("token", "gram").agg(F.count(F.lit(1)).alias("n"))


@query()
def hash_embed_topk(spark, sf_dir):
    """For each benchmark text the five documents with the nearest hashed vectors."""
    embed = T.hash_embedding()
    corpus = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), embed("text").alias("embedding"))
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed("text").alias("qv"))
    return search.batch_top_k(corpus, queries, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def session_facts(spark, sf_dir):
    return session.session_facts(read(spark, sf_dir, "conversations"))


# ------------------------------------------------------------ 8-bit search

FIT = """x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    fit AS (SELECT pos, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 255 ELSE 1.0::DOUBLE / 255 END AS scale, min(x) AS off FROM x GROUP BY pos),
    code AS (SELECT vec_id, x.pos, greatest(0, least(255, round_even((x - off) / scale, 0)))::INTEGER AS c, scale, off FROM x JOIN fit USING (pos))"""


@query(f"WITH {FIT} SELECT pos - 1 AS pos, round(scale, 9) AS scale, round(off, 9) AS offset FROM fit")
def sq8_fit(spark, sf_dir):
    found = search.sq8_fit(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("pos").cast("long").alias("pos"), F.round("scale", 9).alias("scale"), F.round("offset", 9).alias("offset"))


@query(f"WITH {FIT} SELECT vec_id, sum(c)::BIGINT AS total, sum(c * pos)::BIGINT AS mixed FROM code GROUP BY vec_id")
def sq8_encode(spark, sf_dir):
    coded = search.sq8_encode(read(spark, sf_dir, "embeddings")).select("vec_id", F.posexplode("code").alias("pos", "c"))
    return coded.groupBy("vec_id").agg(F.sum("c").alias("total"), F.sum(F.col("c") * (F.col("pos") + 1)).cast("long").alias("mixed"))


@query(f"WITH {FIT}, q AS (SELECT x.pos, x AS qx FROM x WHERE vec_id = 0), s AS (SELECT vec_id, sum((c * scale + off) * qx) AS s FROM code JOIN q USING (pos) GROUP BY vec_id) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10")
def sq8_search(spark, sf_dir):
    coded = search.sq8_encode(read(spark, sf_dir, "embeddings"))
    return search.sq8_search(coded, memories.query_vector(spark, sf_dir), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {FIT}, b AS ({BATCH.format(where='', k=10)}), q AS (SELECT vec_id AS query_id, x.pos, x AS qx FROM x WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, sum((c * scale + off) * qx) AS s FROM code JOIN q USING (pos) GROUP BY ALL),
    f AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 10)
    SELECT round(count(*) / ((SELECT count(DISTINCT query_id) FROM b) * 10.0::DOUBLE), 6) AS recall FROM b SEMI JOIN f USING (query_id, vec_id)""")
def recall_at_k(spark, sf_dir):
    """Recall at 10 of the 8-bit search against the exact one."""
    corpus, queries = read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir)
    coded = search.sq8_encode(corpus).select("vec_id", vector.sq8_decode(F.col("code"), F.col("scale"), F.col("offset")).alias("embedding"))
    found, truth = search.batch_top_k(coded, queries, 10), search.batch_top_k(corpus, queries, 10)
    return search.recall_at_k(found, truth, 10).select(F.round("recall", 6).alias("recall"))


@query()
def sq8_residual_search(spark, sf_dir):
    """The 8-bit search with residual compensation."""
    coded = search.sq8_encode(read(spark, sf_dir, "embeddings"))
    basis = search.residual_basis(coded)
    found = search.residual_search(search.with_residual(coded, basis), memories.query_vector(spark, sf_dir), basis, 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------ log and store

LOGSQL = "log AS (SELECT event_id AS seq, CASE WHEN event_id % 997 = 500 THEN 'CHECKPOINT' WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'purchase' THEN 'UPDATE' ELSE 'INSERT' END AS op, user_id, event_id % 40 AS vec_id, value FROM events)"


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log."""
    op = F.when(F.col("event_id") % 997 == 500, "CHECKPOINT").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "purchase", "UPDATE").otherwise("INSERT")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", (F.col("event_id") % 40).alias("vec_id"), "value")


#: A key lives if an insert follows its last deletion; its last record is the row.
LAST = """marks AS (SELECT user_id, vec_id, max(seq) AS newest, max(seq) FILTER (op = 'INSERT') AS made, coalesce(max(seq) FILTER (op = 'DELETE'), -1) AS gone FROM log WHERE op <> 'CHECKPOINT' GROUP BY 1, 2),
    last AS (SELECT log.* FROM log JOIN marks ON marks.user_id = log.user_id AND marks.vec_id = log.vec_id AND marks.newest = log.seq WHERE made > gone)"""


@query(f"WITH {LOGSQL}, {LAST} SELECT user_id, vec_id, seq, op, value FROM last")
def wal_replay(spark, sf_dir):
    return change_log.replay(op_log(spark, sf_dir)).select("user_id", "vec_id", "seq", "op", "value")


@query(f"WITH {LOGSQL} SELECT seq, op, user_id, vec_id FROM log WHERE seq > (SELECT max(seq) FROM log WHERE op = 'CHECKPOINT')")
def wal_truncate(spark, sf_dir):
    return change_log.truncate(op_log(spark, sf_dir)).select("seq", "op", "user_id", "vec_id")


@query(f"WITH {LOGSQL}, {LAST} SELECT user_id, count(*) AS live FROM last GROUP BY user_id")
def compact_live(spark, sf_dir):
    """Rows per user after a compaction of all inserts by their tombstones: as many as a replay leaves."""
    log = op_log(spark, sf_dir)
    rows = log.where("op = 'INSERT'").groupBy("user_id", "vec_id").agg(F.max("seq").alias("seq"))
    return change_log.compact(rows, log.where("op = 'DELETE'")).groupBy("user_id").agg(F.count(F.lit(1)).alias("live"))


@query("SELECT user_id, event_id, event_type, value FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts, event_id")
def export_user(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    user = events.agg(F.min("user_id")).first()[0]
    return events.where(F.col("user_id") == user).orderBy("ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, round(sum(value), 4) AS total, max(ts) - min(ts) > INTERVAL 1 DAY AS over_a_day FROM events GROUP BY user_id")
def user_stats(spark, sf_dir):
    span = memories.seconds(F.max("ts")) - memories.seconds(F.min("ts"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"), F.round(F.sum("value"), 4).alias("total"), (span > 86400).alias("over_a_day")
    )


@query("SELECT count(DISTINCT user_id) AS users, count(*) AS total, (SELECT max(len(embedding)) FROM embeddings)::INTEGER AS dim FROM events")
def engine_stats(spark, sf_dir):
    dim = read(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("dim"))
    return read(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(dim))


@query("SELECT user_id, event_id, r > 3 AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error')")
def keep_last_n(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return store.latest(rows, "user_id", 3, "ts", "event_id").select("user_id", "event_id", (~F.col("kept")).alias("deleted"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS mem_id FROM events")
def dense_ids(spark, sf_dir):
    """Ids that count up from 0 for each user."""
    events = read(spark, sf_dir, "events").withColumn("at", memories.seconds(F.col("ts")))
    return store.numbered(events.select("user_id", "event_id", "at"), "user_id", "at", "event_id", "mem_id").select("user_id", "event_id", "mem_id")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    p = [F.round(F.percentile("value", F.lit(x)), 6).alias(f"p{round(100 * x)}") for x in (0.5, 0.95, 0.99)]
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*p)
