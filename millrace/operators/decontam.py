"""Word n-grams of training texts that occur in held-out texts.

Grams are compared by two 64-bit hashes, distinct per text, so a text meets a gram once and thirteen-word strings never
leave their task. The held-out grams are counted first: up to BROADCAST_ROWS of them are broadcast and the training
side is not shuffled at all; beyond that both sides are shuffled by hash. Texts without tokens have no grams, shorter
ones than n words one gram of all their words; null ids keep their texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import BROADCAST_ROWS, spread, table
from millrace.functions.columns import ngrams, tokens
from millrace.operators.curate import user_text

N, GATE = 13, 0.02


def grams(df: DataFrame, key: str, text: Column, n: int = N) -> DataFrame:
    """(key, a, b): the hashes of each different gram of each text."""
    words = df.select(key, tokens(text).alias("w"))
    hashed = F.transform(ngrams(F.col("w"), n), lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(g, F.lit(1)).alias("b")))
    return words.select(key, F.explode(hashed).alias("g")).select(key, "g.a", "g.b")


def contaminated(train: DataFrame, against: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(train_id, against_id, n_shared) of each training text that shares grams; against_id is the least that has one."""
    known = against.groupBy("a", "b").agg(F.min("against_id").alias("against_id"))
    small = known.limit(most + 1).count() <= most
    return train.join(F.broadcast(known) if small else known, ["a", "b"]).groupBy("train_id").agg(F.min("against_id").alias("against_id"), F.count("*").alias("n_shared"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def decontam_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = grams(_documents(spark, sf_dir), "doc_id", F.col("text")).withColumnRenamed("doc_id", "train_id")
    return contaminated(train, grams(table(spark, sf_dir, "eval_items"), "item_id", F.col("text")).withColumnRenamed("item_id", "against_id"))


GRAMS = """
{p}w AS (SELECT {key} AS {as_}, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS w FROM {table}),
{p}g AS (SELECT DISTINCT {as_}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) END) AS gram FROM {p}w)"""
BOTH = "WITH " + GRAMS.format(p="a", key="doc_id", as_="train_id", text="text", table="documents") + "," + GRAMS.format(p="b", key="item_id", as_="against_id", text="text", table="eval_items")
HITS = "SELECT train_id, min(against_id) AS against_id, count(DISTINCT gram) AS n_shared FROM ag JOIN bg USING (gram) GROUP BY train_id"
HITS_SQL = f"{BOTH} {HITS}"


def decontam_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, contaminated rows, rate and whether it passes the gate."""
    hits = decontam_hits(spark, sf_dir).agg(F.count("*").alias("n_contaminated"))
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_train"))
    rate = F.col("n_contaminated") / F.greatest(F.lit(1), F.col("n_train"))
    return n.join(F.broadcast(hits), F.lit(True)).select("n_train", "n_contaminated", F.round(rate, 4).alias("overlap_rate"), (rate < GATE).alias("passes"))  # two single rows


REPORT_SQL = f"{BOTH}, h AS ({HITS}), n AS (SELECT count(*) n FROM documents) SELECT n AS n_train, (SELECT count(*) FROM h) AS n_contaminated, round((SELECT count(*) FROM h) / greatest(1, n), 4) AS overlap_rate, (SELECT count(*) FROM h) / greatest(1, n) < 0.02 AS passes FROM n"


def decontam_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that share no gram."""
    hits = decontam_hits(spark, sf_dir).select(F.col("train_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(hits, "doc_id", "left_anti")


CLEAN_SQL = f"{BOTH} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT train_id FROM ag JOIN bg USING (gram))"


def decontam_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows against the messages of all evaluation splits together."""
    d = table(spark, sf_dir, "distilled").select(F.col("rec_id").alias("train_id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text"))
    h = table(spark, sf_dir, "holdout").select(F.col("rec_id").alias("against_id"), user_text().alias("text"))
    return contaminated(grams(spread(d, "train_id"), "train_id", F.col("text")), grams(h, "against_id", F.col("text")))


SPLITS_SQL = (
    "WITH" + GRAMS.format(p="a", key="rec_id", as_="train_id", text="coalesce(title, '') || ' ' || coalesce(abstract, '')", table="distilled")
    + "," + GRAMS.format(p="b", key="rec_id", as_="against_id", text="list_filter(messages, lambda m: m.role = 'user')[1].content", table="holdout") + " " + HITS
)
