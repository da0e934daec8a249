"""Reading, checking and scoring of extractions: reward gates, per-paper scores, report with bootstrap intervals.

A row crosses to Python once, to be read and checked (millrace.functions.jsontext); scores are native expressions.
Null and empty texts gate as no_json; a missing gold extraction counts as an empty one for rewards and is left out,
but counted, in evaluation. Repeated predictions of a paper: the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import spread, table
from millrace.functions import columns as C
from millrace.functions.jsontext import checked, read
from millrace.operators.curate import latest

TRIPLE = "struct<name:string,metric:string,value_num:double,value_str:string>"
EXTRACTION = f"struct<task_type:string,modalities:array<string>,benchmarks:array<{TRIPLE}>,open_source:boolean,claims_sota:boolean,method_keywords:array<string>,one_line_summary:string,limitation_mentioned:string>"
READ = f"struct<gate:string,repeated:boolean,status:string,errors:array<string>,soft_flags:array<string>,parsed:{EXTRACTION}>"
# Penalty of a gate, weights of fields and benchmarks, factor of a soft violation.
PENALTY, W_FIELD, W_BENCH, SOFT_FACTOR = -1.0, 1.0, 3.0, 0.8
SCORES = ("task_type", "modalities", "open_source", "claims_sota", "method_keywords", "benchmarks_soft", "benchmarks_hard")

def reading(text: Column | str) -> Column:
    """READ of a text, in one crossing to Python."""
    return F.udf(read, READ, useArrow=True)(text)


def _stored(e) -> dict:
    """checked() of an extraction stored as a struct, its two value fields taken as one."""
    if e is None:
        return {"gate": "no_json", "repeated": False} | checked(None)
    obj = dict(e.asDict(True) if hasattr(e, "asDict") else e)
    if isinstance(obj.get("benchmarks"), (list, tuple)):
        obj["benchmarks"] = [t and {"name": t["name"], "metric": t["metric"], "value": t["value_num"] if t["value_num"] is not None else t["value_str"]} for t in obj["benchmarks"]]
    result = checked(obj)
    return {"gate": "schema_invalid" if result["status"] == "INVALID" else None, "repeated": False} | result


def stored(extraction: Column | str) -> Column:
    """READ of an extraction that is stored as a struct."""
    return F.udf(_stored, READ)(extraction)


def with_scores(df: DataFrame, pred: str, gold: str, when: Column) -> DataFrame:
    """df with column `s`, the struct of SCORES of two extractions where `when` holds, else null.

    What is compared is prepared once per row in columns of its own, so that pairing works on short values.
    """
    p, g = (lambda f: F.col(f"{pred}.{f}")), (lambda f: F.col(f"{gold}.{f}"))
    made = df.withColumns({"_ok": when})
    made = made.withColumns({f"_{side}{k}": F.when(F.col("_ok"), make(x(f))) for side, x in (("p", p), ("g", g)) for k, f, make in (("b", "benchmarks", C.prepared_triples), ("k", "method_keywords", C.prepared_names))})
    text = lambda x: C.normal_name(F.coalesce(x, F.lit("")))
    same = lambda f: (F.coalesce(p(f), F.lit(False)) == F.coalesce(g(f), F.lit(False))).cast("double").alias(f)
    made = made.withColumns({"_b": F.when(F.col("_ok"), C.greedy_match(F.col("_pb"), F.col("_gb"), C.triple_similarity, C.triple_hit)), "_k": F.when(F.col("_ok"), C.greedy_match(F.col("_pk"), F.col("_gk"), C.closeness))})
    s = F.struct(
        (text(p("task_type")) == text(g("task_type"))).cast("double").alias("task_type"), C.set_f1(p("modalities"), g("modalities")).alias("modalities"), same("open_source"), same("claims_sota"),
        F.col("_k.soft").alias("method_keywords"), F.col("_b.soft").alias("benchmarks_soft"), F.col("_b.hard").alias("benchmarks_hard"),
    )
    return made.withColumn("s", F.when(F.col("_ok"), s)).select(*df.columns, "s")


def mean_of(s: Column, names: tuple[str, ...]) -> Column:
    return sum((s[n] for n in names), F.lit(0.0)) / len(names)


def reward(r: Column, s: Column) -> Column:
    """The gated, weighted reward of a reading and its scores."""
    alpha = F.when(r["status"] == "VALID", 1.0).otherwise(SOFT_FACTOR)
    return F.when(r["gate"].isNotNull(), PENALTY).otherwise(alpha * (W_FIELD * mean_of(s, SCORES[:5]) + W_BENCH * s["benchmarks_soft"]) / (W_FIELD + W_BENCH))


def gold_of_messages(holdout: DataFrame) -> DataFrame:
    """(id, gold) from the last message, checked; gold null where it is no valid extraction."""
    h = latest(holdout.where("id IS NOT NULL").select("id", "rec_id", F.try_element_at("messages", F.lit(-1))["content"].alias("text")), "id", "rec_id")
    return h.select("id", reading("text")["parsed"].alias("gold"))


def predictions(pred: DataFrame) -> DataFrame:
    """(id, r) of the last prediction of each paper, read from text or as stored."""
    p = latest(pred.where("id IS NOT NULL").select("id", "pred_id", "raw_text", "extraction"), "id", "pred_id")
    return p.select("id", F.when(F.col("extraction").isNotNull(), stored("extraction")).otherwise(reading("raw_text")).alias("r"))


def rewards(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """gate, alpha, parts and reward of every prediction with a text against the gold extraction of its paper."""
    r = spread(pred.where("raw_text IS NOT NULL").select("pred_id", "id", "model", "raw_text"), "pred_id").select("pred_id", "id", "model", F.substring(F.sha1("raw_text"), 1, 12).alias("completion_hash"), reading("raw_text").alias("r"))
    scored = with_scores(r.join(gold, "id", "left"), "r.parsed", "gold", F.col("r.gate").isNull())
    return scored.select("pred_id", "id", "model", "completion_hash", F.col("r.gate").alias("gate"), F.col("r.status").alias("status"), F.round(mean_of(F.col("s"), SCORES[:5]), 4).alias("f_field"), F.round("s.benchmarks_soft", 4).alias("f_bench"), F.round(reward(F.col("r"), F.col("s")), 6).alias("reward"))


def gold_of_training(distilled: DataFrame) -> DataFrame:
    rows = distilled.where("id IS NOT NULL AND extraction IS NOT NULL").select("id", "rec_id", "extraction")
    return latest(rows, "id", "rec_id").select("id", F.col("extraction").cast(EXTRACTION).alias("gold"))


def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards(table(spark, sf_dir, "pred"), gold_of_training(table(spark, sf_dir, "distilled")))


def reward_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, their rates and the mean reward by model."""
    r = reward_scores(spark, sf_dir)
    per = r.groupBy("model", F.coalesce("gate", F.lit("none")).alias("gate")).agg(F.count("*").alias("n"), F.sum("reward").alias("total"))
    return per.groupBy("model").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n")))).alias("gates"), F.round(F.sum("total") / F.sum("n"), 6).alias("reward_mean"))


def validate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """status, errors and soft flags of the texts of pred and rejected."""
    p = table(spark, sf_dir, "pred").select(F.lit("pred").alias("tab"), F.col("pred_id").alias("rec_key"), F.col("raw_text").alias("text"))
    q = table(spark, sf_dir, "rejected").select(F.lit("rejected").alias("tab"), F.col("rej_id").alias("rec_key"), F.col("raw").alias("text"))
    return spread(p.unionByName(q), "tab", "rec_key").select("tab", "rec_key", reading("text").alias("r")).select("tab", "rec_key", "r.gate", "r.status", "r.errors", "r.soft_flags")


def paper_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """SCORES, overall and valid of every gold paper; papers without a valid prediction score 0."""
    joined = gold.where("gold IS NOT NULL").join(predictions(pred), "id", "left")
    valid = F.coalesce(F.col("r.status") != "INVALID", F.lit(False))
    scored = with_scores(joined.withColumn("valid", valid), "r.parsed", "gold", F.col("valid"))
    flat = scored.select("id", "valid", *(F.coalesce(F.col(f"s.{c}"), F.lit(0.0)).alias(c) for c in SCORES))
    return flat.withColumn("overall", sum((F.col(c) for c in SCORES[:6]), F.lit(0.0)) / 6)


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = paper_scores(table(spark, sf_dir, "pred"), gold_of_messages(table(spark, sf_dir, "holdout")))
    return s.select("id", "valid", *(F.round(c, 6).alias(c) for c in (*SCORES, "overall")))


def bootstrap(values: DataFrame, *names: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(field, mean, lo, hi): mean and the 2.5 and 97.5 % points of the means of `draws` resamples of values (id, names).

    A row's weight in a resample is Poisson(1), read off a hash of resample and id: each row draws for itself, nothing is
    collected or joined, and sums are combined map-side per resample.
    """
    p, total = 0.36787944117144233, 0.0
    steps = []
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col("id")), F.lit(1 << 52)).cast("double")) / float(1 << 52)
    weight = sum((F.when(u >= t, 1).otherwise(0) for t in steps), F.lit(0))
    drawn = values.select("id", *names, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).withColumn("w", weight)
    sums = drawn.groupBy("b").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
    long = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.try_divide(F.col(n), F.col("w")).alias("m")) for n in names))).alias("x")).select("x.*")
    ends = long.where("m IS NOT NULL").groupBy("field").agg(F.array_sort(F.collect_list("m")).alias("a"))  # `draws` numbers a field
    at = lambda q: F.try_element_at("a", F.least(F.size("a"), F.floor(F.size("a") * q).cast("int") + 1))
    means = values.agg(*(F.avg(n).alias(n) for n in names)).select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("mean")) for n in names))).alias("x")).select("x.*")
    return means.join(F.broadcast(ends), "field", "left").select("field", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n) for n, c in (("mean", F.col("mean")), ("lo", at(0.025)), ("hi", at(0.975)))))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and interval of each field, with papers, share of valid predictions and papers with bad gold."""
    gold = gold_of_messages(table(spark, sf_dir, "holdout"))
    s = paper_scores(table(spark, sf_dir, "pred"), gold)
    counts = s.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col("valid").cast("int")), F.lit(0.0)), 4).alias("valid_json_rate"))
    bad = gold.agg(F.count_if(F.col("gold").isNull()).alias("n_bad_gold"))
    return bootstrap(s, *SCORES, "overall").join(F.broadcast(counts), F.lit(True)).join(F.broadcast(bad), F.lit(True))  # single rows


PAIRS = """
WITH g AS (SELECT id, extraction.benchmarks AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) rn FROM distilled WHERE id IS NOT NULL AND extraction IS NOT NULL) WHERE rn = 1),
p AS (SELECT pred_id, id, unnest(extraction.benchmarks) AS x, unnest(range(len(extraction.benchmarks))) AS i FROM pred WHERE extraction IS NOT NULL),
q AS (SELECT id, unnest(b) AS y, unnest(range(len(b))) AS j FROM g),
n AS (SELECT pred_id, i, j, regexp_replace(lower(coalesce(x.name, '')), '[\\s\\-_./\\\\]+', '', 'g') AS pn, regexp_replace(lower(coalesce(y.name, '')), '[\\s\\-_./\\\\]+', '', 'g') AS gn FROM p JOIN q USING (id) WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT pred_id, i::INT AS i, j::INT AS j, round(CASE WHEN pn = gn THEN 1 WHEN pn = '' OR gn = '' THEN 0 ELSE 1 - levenshtein(pn, gn) / greatest(length(pn), length(gn)) END, 6) AS name_similarity FROM n
"""


def triple_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the names of all result pairs of a prediction and the training row of its paper (pairs within a record)."""
    g = gold_of_training(table(spark, sf_dir, "distilled")).select("id", F.posexplode("gold.benchmarks").alias("j", "y"))
    p = table(spark, sf_dir, "pred").where("extraction IS NOT NULL").select("pred_id", "id", F.posexplode("extraction.benchmarks").alias("i", "x"))
    return p.join(g, "id").where("x IS NOT NULL AND y IS NOT NULL").select("pred_id", "i", "j", F.round(C.similarity(F.col("x.name"), F.col("y.name")), 6).alias("name_similarity"))


def triple_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft and hard F1 of the stored predictions' results."""
    g = gold_of_training(table(spark, sf_dir, "distilled"))
    p = table(spark, sf_dir, "pred").where("extraction IS NOT NULL").select("pred_id", "id", "extraction")
    both = p.join(g, "id").select("pred_id", C.prepared_triples(F.col("extraction.benchmarks")).alias("p"), C.prepared_triples(F.col("gold.benchmarks")).alias("g"))
    return both.withColumn("m", C.greedy_match(F.col("p"), F.col("g"), C.triple_similarity, C.triple_hit)).select("pred_id", F.round("m.soft", 6).alias("soft_f1"), F.round("m.hard", 6).alias("hard_f1"), F.col("m.n_pred").alias("n_pred"), F.col("m.n_gold").alias("n_gold"))


def modality_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold_of_training(table(spark, sf_dir, "distilled"))
    p = table(spark, sf_dir, "pred").where("extraction IS NOT NULL").select("pred_id", "id", F.col("extraction.modalities").alias("m"))
    return p.join(g, "id").select("pred_id", F.round(C.set_f1(F.col("m"), F.col("gold.modalities")), 6).alias("f1"))


MODALITY_SQL = """
WITH g AS (SELECT id, extraction.modalities AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) rn FROM distilled WHERE id IS NOT NULL AND extraction IS NOT NULL) WHERE rn = 1),
s AS (SELECT pred_id, list_distinct(list_transform(coalesce(extraction.modalities, []), lambda x: regexp_replace(lower(coalesce(x, 'None')), '[\\s\\-_./\\\\]+', '', 'g'))) AS p,
  list_distinct(list_transform(coalesce(b, []), lambda x: regexp_replace(lower(coalesce(x, 'None')), '[\\s\\-_./\\\\]+', '', 'g'))) AS q FROM pred JOIN g USING (id) WHERE extraction IS NOT NULL)
SELECT pred_id, round(CASE WHEN len(p) = 0 AND len(q) = 0 THEN 1 WHEN len(list_intersect(p, q)) = 0 THEN 0 ELSE 2 * len(list_intersect(p, q)) / (len(p) + len(q)) END, 6) AS f1 FROM s
"""
