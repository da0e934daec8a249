"""Curation: latest and first rows, funnel, exact samples by hash, split, review queue, datacard, resume.

Rows are picked with max_by/min_by, which combine map-side, so an id that holds a third of all rows is no hot key.
Exact counts by hash order come from a histogram of hash prefixes (bounded) and one bin that is ranked: no global sort.
Null ids are one id; empty tables give empty results (ratios 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.base import table
from millrace.functions.columns import keyed

# Fixed values of the curation rules.
PRIMARY, FIRST_YYMM, LENGTHS, NUMERIC = ("cs.CL", "cs.LG"), 2507, (100, 3000), "\\d+\\.\\d+|\\d+%"
SOFT_WARNING = 0.15


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the least `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def yymm(paper: Column) -> Column:
    """The year and month that a new-style id begins with, null for others."""
    return F.regexp_extract(paper, "^(\\d{4})\\.\\d{4,5}", 1).try_cast("int")


def numeric_signal(text: Column) -> Column:
    """Whether a text has two or more decimals or percentages."""
    return F.coalesce(F.regexp_count(text, F.lit(NUMERIC)) >= 2, F.lit(False))


def staged(papers: DataFrame) -> DataFrame:
    """Latest row of each id with the funnel's flags; a stage holds only if those before it do."""
    df = latest(papers.select("id", "categories", "abstract", "ingest_seq"), "id", "ingest_seq")
    category = F.coalesce(F.regexp_extract("categories", "\\S+", 0).isin(*PRIMARY), F.lit(False))
    window = category & F.coalesce(yymm(F.col("id")) >= FIRST_YYMM, F.lit(False))
    length = window & F.coalesce(F.length("abstract").between(*LENGTHS), F.lit(False))
    return df.select("id", "abstract", category.alias("primary_cat"), window.alias("id_window_ok"), length.alias("len_ok"), (length & numeric_signal(F.col("abstract"))).alias("numeric"))


def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers_pool")
    counts = staged(papers).agg(F.count("*").alias("unique_ids"), *(F.count_if(c).alias(c) for c in ("primary_cat", "id_window_ok", "len_ok", "numeric")))
    lines = papers.agg(F.count("*").alias("raw_lines"))
    return counts.join(F.broadcast(lines), F.lit(True)).select("raw_lines", *counts.columns)  # two single rows


FUNNEL_SQL = r"""
WITH latest AS (SELECT * FROM (SELECT id, categories, abstract, row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) rn FROM papers_pool) WHERE rn = 1),
flags AS (SELECT coalesce(regexp_extract(categories, '[^ \t\r\n\f\v]+') IN ('cs.CL', 'cs.LG'), false) a, coalesce(TRY_CAST(regexp_extract(id, '^(\d{4})\.\d{4,5}', 1) AS INT) >= 2507, false) b,
  coalesce(length(abstract) BETWEEN 100 AND 3000, false) c, coalesce(len(regexp_extract_all(abstract, '\d+\.\d+|\d+%')) >= 2, false) d FROM latest)
SELECT (SELECT count(*) FROM papers_pool) AS raw_lines, count(*) AS unique_ids, count(*) FILTER (a) AS primary_cat, count(*) FILTER (a AND b) AS id_window_ok, count(*) FILTER (a AND b AND c) AS len_ok,
  count(*) FILTER (a AND b AND c AND d) AS "numeric" FROM flags
"""


def papers_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "papers_pool").select("id", "ingest_seq", "title", "categories"), "id", "ingest_seq")


LATEST_SQL = "SELECT id, ingest_seq, title, categories FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) rn FROM papers_pool) WHERE rn = 1"


def distilled_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(table(spark, sf_dir, "distilled").where("validator_status = 'VALID'").select("id", "rec_id", "teacher"), "id", "rec_id")


FIRST_SQL = "SELECT id, rec_id, teacher FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id) rn FROM distilled WHERE validator_status = 'VALID') WHERE rn = 1"


def id_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "papers_pool").select("ingest_seq", yymm(F.col("id")).alias("yymm"), F.coalesce(yymm(F.col("id")) >= FIRST_YYMM, F.lit(False)).alias("in_window"), numeric_signal(F.col("abstract")).alias("has_numbers"))


WINDOW_SQL = r"""SELECT ingest_seq, TRY_CAST(regexp_extract(id, '^(\d{4})\.\d{4,5}', 1) AS INT) AS yymm, coalesce(TRY_CAST(regexp_extract(id, '^(\d{4})\.\d{4,5}', 1) AS INT) >= 2507, false) AS in_window,
 coalesce(len(regexp_extract_all(abstract, '\d+\.\d+|\d+%')) >= 2, false) AS has_numbers FROM papers_pool"""


def lowest(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly n rows (all if there are fewer): those with the least keyed(seed, key), ties by key.

    A histogram of the first 12 bits of the hash tells the bin in which the n-th row lies; rows of lower bins are in,
    and only that bin, a 4096th of the rows, is ranked.
    """
    hashed = df.withColumn("_h", keyed(seed, F.col(key))).withColumn("_bin", F.shiftright("_h", 48).cast("int"))
    counts, below, last = sorted((r["_bin"], r["count"]) for r in hashed.groupBy("_bin").count().collect()), 0, None
    for b, c in counts:
        if below + c >= n:
            last = b
            break
        below += c
    if last is None:
        return hashed.drop("_h", "_bin")
    ranked = hashed.where(F.col("_bin") == last).withColumn("_rank", F.row_number().over(Window.partitionBy("_bin").orderBy("_h", key))).where(F.col("_rank") <= n - below)
    return hashed.where(F.col("_bin") < last).unionByName(ranked.drop("_rank")).drop("_h", "_bin")


def quotas(n_numeric: int, n_plain: int, n: int, ratio: float, floor: float = 0.25) -> tuple[int, int]:
    """Rows to take of both strata: a floor for the plain one first, what is short filled from the numeric one."""
    numeric = min(n_numeric, int(n * ratio), n - min(n_plain, int(n * floor)))
    plain = min(n_plain, n - numeric)
    return (min(n_numeric, n - plain) if numeric + plain < n else numeric), plain


def stratified_sample(pool: DataFrame, n: int, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """An exact sample of rows with and without numeric_signal (null counts as without)."""
    flagged = pool.withColumn("numeric_signal", F.coalesce("numeric_signal", F.lit(False)))
    counts = flagged.agg(F.count_if("numeric_signal").alias("a"), F.count_if(~F.col("numeric_signal")).alias("b")).first()
    a, b = quotas(counts["a"], counts["b"], n, ratio)
    return lowest(flagged.where("numeric_signal"), a, seed).unionByName(lowest(flagged.where("NOT numeric_signal"), b, seed))


def sample_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers_pool").where("id IS NOT NULL").select("id", "ingest_seq", "numeric_signal")
    return stratified_sample(latest(papers, "id", "ingest_seq"), 200, 0.5).select("id", "numeric_signal")


HASH = "('0x' || substr(md5('{seed}|' || id), 1, 15))::BIGINT"
SAMPLE_SQL = f"""
WITH pool AS (SELECT id, coalesce(numeric_signal, false) AS numeric_signal FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) rn FROM papers_pool WHERE id IS NOT NULL) WHERE rn = 1),
c AS (SELECT count(*) FILTER (numeric_signal) a, count(*) FILTER (NOT numeric_signal) b FROM pool),
q1 AS (SELECT a, b, least(a, 100, 200 - least(b, 50)) AS num FROM c), q2 AS (SELECT a, num, least(b, 200 - num) AS plain FROM q1),
q AS (SELECT CASE WHEN num + plain < 200 THEN least(a, 200 - plain) ELSE num END AS num, plain FROM q2),
r AS (SELECT id, numeric_signal, row_number() OVER (PARTITION BY numeric_signal ORDER BY {HASH.format(seed=42)}, id) AS k FROM pool)
SELECT id, numeric_signal FROM r, q WHERE k <= CASE WHEN numeric_signal THEN num ELSE plain END
"""


def split(df: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(holdout of n rows, the rest); an error if there are not more than n."""
    if (have := df.count()) - 1 < n:
        raise ValueError(f"{n} rows were asked for the holdout, {max(0, have - 1)} can be given")
    held = lowest(df, n, seed)
    return held, df.join(held.select("id"), "id", "left_anti")


def unique_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "distilled").where("validator_status = 'VALID' AND id IS NOT NULL").select("id", "rec_id", "sota_disagree", "grounding_flags", "title")
    return first(rows, "id", "rec_id")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, rest = split(unique_valid(spark, sf_dir), 20)
    return held.select("id", F.lit("holdout").alias("part")).unionByName(rest.select("id", F.lit("train").alias("part")))


SPLIT_SQL = f"""
WITH u AS (SELECT id FROM distilled WHERE validator_status = 'VALID' AND id IS NOT NULL GROUP BY id)
SELECT id, CASE WHEN row_number() OVER (ORDER BY {HASH.format(seed=42)}, id) <= 20 THEN 'holdout' ELSE 'train' END AS part FROM u
"""


def scaling_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested prefixes of the training part by hash order: (subset, id)."""
    rows = unique_valid(spark, sf_dir)
    parts = [lowest(rows, n, 7).select(F.lit(n).alias("subset"), "id") for n in (10, 20, 40)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SUBSETS_SQL = f"""
WITH u AS (SELECT id, row_number() OVER (ORDER BY {HASH.format(seed=7)}, id) k FROM (SELECT id FROM distilled WHERE validator_status = 'VALID' AND id IS NOT NULL GROUP BY id))
SELECT n AS subset, id FROM u, (VALUES (10), (20), (40)) t(n) WHERE k <= n
"""


def suspect() -> Column:
    flags = F.size(F.filter(F.coalesce("grounding_flags", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return F.coalesce("sota_disagree", F.lit(False)) | (flags > 0)


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 rows to look at first: suspects before others, each by hash (a top-k report)."""
    rows = unique_valid(spark, sf_dir).withColumn("suspect", suspect()).withColumn("h", keyed(42, F.col("id")))
    return rows.orderBy(F.desc("suspect"), "h", "id").limit(50).select("id", "suspect")


REVIEW_SQL = f"""
WITH u AS (SELECT id, coalesce(sota_disagree, false) OR len(list_filter(coalesce(grounding_flags, []), lambda x: x IS NOT NULL)) > 0 AS suspect
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id) rn FROM distilled WHERE validator_status = 'VALID' AND id IS NOT NULL) WHERE rn = 1)
SELECT id, suspect FROM u ORDER BY suspect DESC, {HASH.format(seed=42)}, id LIMIT 50
"""


def datacard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "distilled").where("id IS NOT NULL").select("id", "rec_id", "validator_status", "sota_disagree", "grounding_flags", F.size("extraction.benchmarks").alias("n_benchmarks"))
    totals = d.agg(F.count_if(F.expr("validator_status = 'VALID'")).alias("valid_rows"), F.count_if(F.expr("validator_status = 'SOFT_VIOLATION'")).alias("soft_skipped"))
    u = first(d.where("validator_status = 'VALID'").drop("validator_status"), "id", "rec_id")
    flagged = F.size(F.filter(F.coalesce("grounding_flags", F.array().cast("array<string>")), lambda x: x.isNotNull())) > 0
    share = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0)), 3)
    card = u.agg(F.count("*").alias("unique_rows"), share(F.col("sota_disagree")).alias("sota_disagree_ratio"), share(flagged).alias("grounding_flag_ratio"), share(F.col("n_benchmarks") > 0).alias("benchmarks_nonempty_ratio"))
    soft = F.round(F.col("soft_skipped") / F.greatest(F.lit(1), F.col("valid_rows") + F.col("soft_skipped")), 3)
    return card.join(F.broadcast(totals), F.lit(True)).withColumn("soft_ratio", soft).withColumn("soft_warning", F.col("soft_ratio") > SOFT_WARNING)  # two single rows


CARD_SQL = """
WITH d AS (SELECT * FROM distilled WHERE id IS NOT NULL),
u AS (SELECT *, len(list_filter(coalesce(grounding_flags, []), lambda x: x IS NOT NULL)) > 0 AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id) rn FROM d WHERE validator_status = 'VALID') WHERE rn = 1),
t AS (SELECT count(*) FILTER (validator_status = 'VALID') AS valid_rows, count(*) FILTER (validator_status = 'SOFT_VIOLATION') AS soft_skipped FROM d)
SELECT count(*) AS unique_rows, round(coalesce(avg(coalesce(sota_disagree, false)::INT), 0), 3) AS sota_disagree_ratio, round(coalesce(avg(flagged::INT), 0), 3) AS grounding_flag_ratio,
  round(coalesce(avg(coalesce(len(extraction.benchmarks) > 0, false)::INT), 0), 3) AS benchmarks_nonempty_ratio, any_value(t.valid_rows) AS valid_rows, any_value(t.soft_skipped) AS soft_skipped,
  round(any_value(t.soft_skipped) / greatest(1, any_value(t.valid_rows) + any_value(t.soft_skipped)), 3) AS soft_ratio,
  round(any_value(t.soft_skipped) / greatest(1, any_value(t.valid_rows) + any_value(t.soft_skipped)), 3) > 0.15 AS soft_warning FROM u, t
"""


def remaining(rows: DataFrame, *done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key none of `done` has; rows without a key stay."""
    seen = done[0].select(key)
    for d in done[1:]:
        seen = seen.unionByName(d.select(key))
    return rows.join(seen.distinct(), key, "left_anti")


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers neither distilled nor rejected yet."""
    papers = latest(table(spark, sf_dir, "papers_pool").select("id", "ingest_seq"), "id", "ingest_seq")
    return remaining(papers, table(spark, sf_dir, "distilled"), table(spark, sf_dir, "rejected"))


RESUME_SQL = "SELECT id, max(ingest_seq) AS ingest_seq FROM papers_pool p WHERE NOT EXISTS (SELECT 1 FROM distilled d WHERE d.id = p.id) AND NOT EXISTS (SELECT 1 FROM rejected r WHERE r.id = p.id) GROUP BY id"


def blacklist_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected ids as a blacklist: those among flagged training rows, and those not."""
    black = table(spark, sf_dir, "rejected").where("id IS NOT NULL").select("id").distinct()
    flagged = table(spark, sf_dir, "distilled").where(suspect()).select("id")
    return black.intersect(flagged).withColumn("flagged", F.lit(True)).unionByName(black.subtract(flagged).withColumn("flagged", F.lit(False)))


BLACKLIST_SQL = """
WITH f AS (SELECT DISTINCT id FROM distilled WHERE coalesce(sota_disagree, false) OR len(list_filter(coalesce(grounding_flags, []), lambda x: x IS NOT NULL)) > 0)
SELECT DISTINCT id, id IN (SELECT id FROM f WHERE id IS NOT NULL) AS flagged FROM rejected WHERE id IS NOT NULL
"""


def user_text() -> Column:
    """Content of the first user message."""
    return F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"]


def first_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "holdout").select("rec_id", user_text().alias("user_text"), F.size("messages").alias("n_messages"))


USER_SQL = "SELECT rec_id, list_filter(messages, lambda m: m.role = 'user')[1].content AS user_text, len(messages)::INT AS n_messages FROM holdout"
INSTRUCTION = "Return the metadata of the paper as one JSON object."


def messages(spark: SparkSession, sf_dir: str, instruction: str = INSTRUCTION) -> DataFrame:
    """Chat rows of training: instruction, paper, and the extraction as compact JSON in field order, nulls kept."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    paper = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit("")))
    answer = F.to_json("extraction", {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "distilled").select("rec_id", "id", F.array(say("system", F.lit(instruction)), say("user", paper), say("assistant", answer)).alias("messages"))
