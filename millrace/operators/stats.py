"""Statistics of groups of completions: advantages, repeats, entropy, behaviour, penalties; actions and segments.

Groups are aggregated map-side; where a value needs its group's mean, the means are joined back instead of a window, so
that a group with a third of all rows is one row of the small side. Null groups and values are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.base import table
from millrace.functions.columns import action, last_answer, tokens, until_action

# Guard of the advantage, penalties of the final run.
GUARD, NO_SEARCH, NO_ANSWER, BAD_ACTION = 1e-4, 0.8, 0.3, 0.1


def advantages(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with (value - mean of its group) / (sample deviation + GUARD); null in groups of one."""
    means = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(means, group).withColumn("advantage", (F.col(value) - F.col("_m")) / (F.col("_s") + GUARD)).drop("_m", "_s")


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = advantages(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return got.select("event_id", F.round("advantage", 6).alias("advantage"))


ADVANTAGE_SQL = """
WITH m AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1)
SELECT event_id, round((value - m) / (s + 1e-4), 6) AS advantage FROM events JOIN m USING (user_id)
"""


def dedup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions, different completions and their ratio by paper, for papers with two or more."""
    p = table(spark, sf_dir, "pred").where("id IS NOT NULL AND raw_text IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(F.sha1("raw_text")).alias("n_distinct"))
    return p.where("n >= 2").select("id", "n", "n_distinct", F.round(F.col("n_distinct") / F.col("n"), 6).alias("rate"))


DEDUP_SQL = "SELECT id, count(*) AS n, count(DISTINCT raw_text) AS n_distinct, round(count(DISTINCT raw_text) / count(*), 6) AS rate FROM pred WHERE id IS NOT NULL AND raw_text IS NOT NULL GROUP BY id HAVING count(*) >= 2"


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy in bits of a value's shares in each group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return totals.select(group, F.round(F.log2("total") - F.col("x") / F.col("total"), 6).alias("bits"))  # -sum p log p


def task_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "distilled").select("teacher", F.col("extraction.task_type").alias("task_type"))
    return entropy(d, "teacher", "task_type")


ENTROPY_SQL = """
WITH c AS (SELECT teacher, extraction.task_type AS t, count(*) AS n FROM distilled WHERE extraction.task_type IS NOT NULL GROUP BY 1, 2)
SELECT teacher, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM c GROUP BY teacher
"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First action, last answer and the text up to the first action of every stored output."""
    p = table(spark, sf_dir, "pred").where("raw_text IS NOT NULL").select("pred_id", "raw_text", action(F.col("raw_text")).alias("a"))
    return p.select("pred_id", F.col("a.kind").alias("kind"), F.col("a.content").alias("content"), last_answer(F.col("raw_text")).alias("answer"), F.length(until_action(F.col("raw_text"))).alias("kept"))


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
ACTIONS_SQL = f"""
WITH x AS (SELECT pred_id, raw_text, position('<search>' IN raw_text) AS s, position('<answer>' IN raw_text) AS a, regexp_extract(raw_text, '(?s)<search>(.*?)</search>', 1) AS st, regexp_matches(raw_text, '(?s)<search>.*?</search>') AS hs,
  regexp_extract(raw_text, '(?s)<answer>(.*?)</answer>', 1) AS ans, regexp_matches(raw_text, '(?s)<answer>.*?</answer>') AS ha FROM pred WHERE raw_text IS NOT NULL)
SELECT pred_id, CASE WHEN hs AND (NOT ha OR s < a) THEN 'search' WHEN ha THEN 'answer' END AS kind, {STRIP.format("CASE WHEN hs AND (NOT ha OR s < a) THEN st WHEN ha THEN ans ELSE '' END")} AS content,
  {STRIP.format("coalesce(list_extract(regexp_extract_all(raw_text, '(?s)<answer>(.*?)</answer>', 1), -1), '')")} AS answer,
  (CASE WHEN contains(raw_text, '</search>') THEN length(split_part(raw_text, '</search>', 1)) + 9 WHEN contains(raw_text, '</answer>') THEN length(split_part(raw_text, '</answer>', 1)) + 9 ELSE length(raw_text) END)::INT AS kept FROM x
"""


def penalty(answered: Column, searches: Column, invalid: Column) -> Column:
    """What is taken off a reward for answering unsearched, not answering, and invalid actions."""
    return F.when(answered & (searches == 0), NO_SEARCH).otherwise(0.0) + F.when(answered, 0.0).otherwise(NO_ANSWER) + invalid * BAD_ACTION


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of searching and answering and the mean penalty of stored outputs by mode."""
    p = table(spark, sf_dir, "pred").where("raw_text IS NOT NULL").select("mode", F.regexp_count("raw_text", F.lit("(?s)<search>.*?</search>")).alias("s"), F.col("raw_text").rlike("(?s)<answer>.*?</answer>").alias("a"))
    return p.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg((F.col("s") > 0).cast("int")), 6).alias("search_rate"), F.round(F.avg(F.col("a").cast("int")), 6).alias("answered_rate"), F.round(F.avg(penalty(F.col("a"), F.col("s"), F.lit(0))), 6).alias("mean_penalty"))


BEHAVIOUR_SQL = """
WITH p AS (SELECT mode, len(regexp_extract_all(raw_text, '(?s)<search>.*?</search>')) AS s, regexp_matches(raw_text, '(?s)<answer>.*?</answer>') AS a FROM pred WHERE raw_text IS NOT NULL)
SELECT mode, count(*) AS n, round(avg((s > 0)::INT), 6) AS search_rate, round(avg(a::INT), 6) AS answered_rate, round(avg(CASE WHEN a AND s = 0 THEN 0.8 ELSE 0 END + CASE WHEN a THEN 0 ELSE 0.3 END), 6) AS mean_penalty FROM p GROUP BY mode
"""


def segments(rows: DataFrame, key: str, budget: int = 256) -> DataFrame:
    """(key, seg, role, n_tokens, kept, mask): messages as segments under a budget of tokens, mask 1 for the model's own.

    A record's messages are one frame; what exceeds the running budget is cut.
    """
    m = rows.select(key, F.posexplode("messages").alias("seg", "m")).where("m IS NOT NULL").select(key, "seg", F.col("m.role").alias("role"), F.size(tokens(F.col("m.content"))).alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.lit(budget) - before))
    return m.select(key, "seg", "role", "n_tokens", kept.cast("int").alias("kept"), F.coalesce((F.col("role") == "assistant").cast("int"), F.lit(0)).alias("mask"))


def mask_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(table(spark, sf_dir, "holdout"), "rec_id")


SEGMENTS_SQL = """
WITH m AS (SELECT rec_id, unnest(messages) AS m, unnest(range(len(messages)))::INT AS seg FROM holdout),
t AS (SELECT rec_id, seg, m.role AS role, len(regexp_extract_all(lower(coalesce(m.content, '')), '[a-z0-9]+'))::INT AS n_tokens FROM m WHERE m IS NOT NULL)
SELECT rec_id, seg, role, n_tokens, greatest(0, least(n_tokens, 256 - coalesce(sum(n_tokens) OVER (PARTITION BY rec_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INT AS kept, coalesce((role = 'assistant')::INT, 0) AS mask FROM t
"""


def mask_arrays(segs: DataFrame, key: str, width: int) -> DataFrame:
    """(key, mask): the masks of a record's kept tokens in order, filled with 0 up to `width`."""
    per = segs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg", "kept", "mask"))).alias("x"))  # one record's segments
    flat = F.flatten(F.transform("x", lambda s: F.array_repeat(s["mask"], s["kept"])))
    return per.select(key, F.concat(flat, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(width) - F.size(flat)))).alias("mask"))
