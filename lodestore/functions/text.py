"""Tokenisers, noise and category rules, n-grams and TF-IDF, as expressions; hashed embeddings as a pandas UDF."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Word lists, keywords and field names, in their given order.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "was", "are", "were", "be", "been",
    "has", "have", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "it", "its", "this", "that", "i", "you",
    "he", "she", "we", "they", "not", "no", "so", "as", "if", "then",
]
NOISE_WORDS = [
    "ok", "okay", "yes", "no", "yeah", "nope", "sure",
    "lol", "haha", "thanks", "thank", "thx", "bye",
    "hello", "hi", "hey", "coucou", "salut", "merci",
    "cool", "nice", "great", "good", "wow", "ah",
    "oui", "non", "bof", "ouais", "voila", "voilà",
    "d accord", "d'accord", "parfait", "super",
]
CATEGORIES = {
    "tech_stack": ["react", "vue", "python", "javascript", "typescript", "node", "code", "framework", "library", "api", "backend", "frontend", "database", "sql", "git"],
    "preference": ["prefer", "like", "love", "hate", "always", "never", "favorite", "dark mode", "light mode", "ui", "ux"],
    "learning": ["learning", "studying", "course", "tutorial", "beginner", "understand", "practice"],
    "product": ["pricing", "plan", "pro", "upgrade", "subscription", "billing", "free", "trial", "dashboard"],
    "sentiment": ["happy", "sad", "excited", "worried", "frustrated", "great", "terrible", "love", "hate"],
    "work": ["work", "job", "company", "team", "project", "meeting", "office", "remote", "client"],
}
ATOMIC_FIELDS = ["action", "event", "type", "eventType", "event_type"]
STOP_FIELDS = ["timestamp", "ts", "created_at", "updated_at", "time"]
UNSPOKEN_FIELDS = ["timestamp", "reinforcements"]
HASH_TOKEN = "[0-9a-zàâäéèêëîïôöùûüçñ]+"


def tokens(text: Column, min_length: int = 2, stopwords=STOPWORDS) -> Column:
    """Lower-cased words without ASCII punctuation, short words and stop words; repeats stay."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), string.punctuation, " " * len(string.punctuation))
    listed = F.split(spaced, r"\s+")
    return F.filter(listed, lambda w: (F.length(w) >= min_length) & ~w.isin(list(stopwords)))


def is_substantial(text: Column, min_length: int = 4) -> Column:
    """Whether a message has enough words, two of them not noise."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return (F.size(found) >= min_length) & (F.size(F.filter(found, lambda w: ~w.isin(NOISE_WORDS))) >= 2)


def category(text: Column) -> Column:
    """The first category of which any keyword occurs in the text, as a substring."""
    lowered, out = F.lower(text), None
    for name, keywords in CATEGORIES.items():
        hit = lowered.rlike("|".join(re.escape(k) for k in keywords))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def char_ngrams(token: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of ``^token$`` and the whole token as ``#token``."""
    framed = F.concat(F.lit("^"), token, F.lit("$"))
    size = F.length(framed)

    def grams(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(framed, i, F.lit(n)))
        return F.when(size >= n, found).otherwise(F.array().cast("array<string>"))

    lists = [grams(n) for n in range(low, high + 1)]
    return F.concat(*lists, F.array(F.concat(F.lit("#"), token)))


def document_frequency(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """token, df."""
    distinct = docs.select(F.explode(F.array_distinct(tokens(F.col(text_column)))).alias("token"))
    return distinct.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(df: DataFrame, n_docs: int) -> DataFrame:
    """token, df and the smoothed inverse document frequency."""
    return df.withColumn("idf", F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)


def vocabulary(df: DataFrame) -> DataFrame:
    """token and its number in sorted order.

    Tokens are numbered among those of the same first characters; the sizes of
    these groups, one row each, give the offsets, so no task sorts the whole
    vocabulary.
    """
    start = F.substring("token", 1, 3)
    tokens_ = df.select("token").distinct().withColumn("start", start)
    sizes = tokens_.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("start").orderBy("token"))
    return tokens_.withColumn("rank", rank).join(before, "start").select("token", (F.col("offset") + F.col("rank") - 1).alias("idx"))


def grown_vocabulary(known: DataFrame, df: DataFrame) -> DataFrame:
    """``known`` (token, idx) and the tokens of ``df`` that it lacks, numbered on in sorted order."""
    new = vocabulary(df.join(known, "token", "left_anti"))
    size = known.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("size"))
    return known.select("token", "idx").unionByName(new.crossJoin(F.broadcast(size)).select("token", (F.col("idx") + F.col("size")).alias("idx")))


def merged_frequency(df: DataFrame, more: DataFrame) -> DataFrame:
    """Document frequencies of two batches together."""
    return df.unionByName(more).groupBy("token").agg(F.sum("df").alias("df"))


def term_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n (tokens of the text), token, times: a row for each distinct token of each row, counted inside the row."""
    listed = docs.select(id_column, F.array_sort(tokens(F.col(text_column))).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    starts = F.expr("filter(sequence(1, n), i -> i = 1 or element_at(t, i) <> element_at(t, i - 1))")
    spans = F.expr("zip_with(s, slice(s, 2, n), (a, b) -> struct(element_at(t, a) as token, coalesce(b, n + 1) - a as times))")
    return listed.withColumn("s", starts).select(id_column, "n", F.explode(spans).alias("x")).select(id_column, "n", "x.token", F.col("x.times").cast("long").alias("times"))


def tfidf(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, token, tfidf over the corpus's own frequencies.

    Only distinct tokens of a text are shuffled; the corpus size joins as one row,
    and the frequencies by token (Spark broadcasts them while they are small and
    splits frequent tokens where they are not).
    """
    counted = term_counts(docs, id_column, text_column)
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    df = counted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))
    weights = df.select("token", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    return counted.join(weights, "token").select(id_column, "token", (F.col("times") / F.col("n") * F.col("idf")).alias("tfidf"))


def event_tokens(action: Column, metadata: Column) -> Column:
    """Tokens of an event: its action, then its string fields (a map) in order.

    Fields of ``STOP_FIELDS`` are left out; a value without a blank in a field of
    ``ATOMIC_FIELDS``, or as action, stays one token.
    """
    whole = lambda v: F.array(F.lower(v))
    one = lambda v: ~F.trim(v).contains(" ")
    field = lambda e: F.when(e["key"].isin(ATOMIC_FIELDS) & one(e["value"]), whole(e["value"])).otherwise(tokens(e["value"]))
    spoken = F.filter(F.map_entries(metadata), lambda e: ~e["key"].isin(STOP_FIELDS) & e["value"].isNotNull())
    first = F.when(action.isNull(), F.array().cast("array<string>")).when(one(action), whole(action)).otherwise(tokens(action))
    return F.concat(first, F.coalesce(F.flatten(F.transform(spoken, field)), F.array().cast("array<string>")))


def event_text(action: Column, metadata: Column) -> Column:
    """An event as a text: its action and the values of its fields, without times, counters and ``__`` fields."""
    spoken = F.filter(F.map_entries(metadata), lambda e: ~e["key"].isin(UNSPOKEN_FIELDS) & ~e["key"].startswith("__"))
    values = F.transform(spoken, lambda e: e["value"])
    return F.concat_ws(" ", F.when(action != "", action), F.coalesce(values, F.array().cast("array<string>")))


def bucket(gram: str, dim: int) -> tuple[int, float]:
    """Signed cell of a gram: the 64-bit BLAKE2b digest picks both."""
    value = int.from_bytes(hashlib.blake2b(gram.encode("utf-8"), digest_size=8).digest(), "big")
    return value % dim, 1.0 if (value // dim) & 1 else -1.0


#: Tokens whose cells are remembered.
REMEMBERED = 50_000


def hash_vector(text: str | None, dim: int = 256, low: int = 3, high: int = 5, memory: dict | None = None) -> np.ndarray:
    """Unit vector of a text's signed gram counts; zero without a token."""
    memory = {} if memory is None else memory
    out = np.zeros(dim)
    for token in re.findall(HASH_TOKEN, (text or "").lower()):
        part = memory.get(token)
        if part is None:
            framed = f"^{token}$"
            grams = [framed[i : i + n] for n in range(low, high + 1) for i in range(len(framed) - n + 1)] + [f"#{token}"]
            cells = [bucket(g, dim) for g in grams]
            part = np.array([c for c, _ in cells]), np.array([x for _, x in cells])
            if len(memory) < REMEMBERED:
                memory[token] = part
        np.add.at(out, *part)
    n = np.linalg.norm(out)
    return (out / n if n else out).astype(np.float32)


def hash_embedding(dim: int = 256):
    """A pandas UDF from text to its hashed unit vector; the cells of distinct tokens are remembered while a task runs."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict = {}
        for texts in batches:
            yield pd.Series([hash_vector(t, dim, memory=memory) for t in texts])

    return embed
