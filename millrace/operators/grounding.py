"""Extractions against their text: numbers, names, modalities, open source, and claims of the state of the art.

Patterns run inside the JVM; only code mentions and claims, which look at the surroundings of each match, are cut out as
arrays of surroundings first. Null titles and abstracts count as empty, null extractions have no flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import table
from millrace.functions.columns import strip, tokens

# Patterns of evidence, and words that stand for a missing name.
PLACEHOLDERS = ("unspecified", "n/a", "na", "unknown", "none", "not specified", "null", "")
EVIDENCE = {
    "image": r"\b(images?|visual(?:ly)?|vision|photo\w*|pictures?|pixels?|ocr|scan(?:ned|s)?|imagery)\b",
    "audio": r"\b(audio|speech|acoustic\w*|voice|spoken|asr|tts|phonemes?|music(?:al)?)\b",
    "video": r"\b(videos?)\b",
}
CODE_PHRASE = r"\b(code\s+(?:generation|completion|search|review|repair|synthesis|translation)|source\s+code|programming|coding|codebases?|program\s+synthesis|sql)\b"
RELEASE = r"(available|released?|release|public(?:ly)?|open[-\s]?sourced?|github|gitlab|repositor\w+|will\s+be|huggingface)"
OPEN_SOURCE = (
    r"(https?://\S+|github\.com|gitlab|huggingface\.co|open[-\s]?sourc\w+|(?:code|data|dataset|model|checkpoint)s?\s+(?:is|are|will\s+be)\s+(?:made\s+)?(?:publicly\s+)?(?:available|released)"
    r"|will\s+be\s+(?:made\s+)?(?:publicly\s+)?(?:available|released)|(?:publicly|freely)\s+available|available\s+at|released?\s+(?:at|our)|we\s+(?:release|open[-\s]?source))"
)
BEST = r"(?:\bsota\b|state[-\s]of[-\s]the[-\s]art|\boutperform\w*\s+all\b|\bsurpass\w*\s+all\b|\bprevious\s+best\b)"
UNLIKE = r"(comparable|close\s+to|match(es|ing)?|approach(es|ing)?|near|on\s+par|\bnot\b|\bno\b|does\s+not|do\s+not|fails?\s+to|without|unable\s+to|falls?\s+short)"
CLAUSE = r"[;:]|,\s+(?:and|but|while|whereas|although|though)\b"
AROUND, BEFORE = 50, 60
LOOSE = "(?iU)"


def surroundings(text: Column, pattern: str, before: int, after: int) -> Column:
    """Array of (text before, text after) each match, as far as the two widths reach."""
    mark = "\u0001"
    marked = F.split(F.regexp_replace(F.regexp_replace(text, mark, " "), f"{LOOSE}({pattern})", f"{mark}$1{mark}"), mark)
    # Odd places of the split are the matches; what lies before one is all parts up to it, cut to the width.
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(marked) - 2)), lambda i: (i % 2 == 1) & (i < F.size(marked) - 1))
    left = lambda i: F.array_join(F.slice(marked, 1, i), "")
    right = lambda i: F.array_join(F.slice(marked, i + 2, F.size(marked)), "")
    return F.transform(places, lambda i: F.struct(F.right(left(i), F.lit(before)).alias("before"), F.left(right(i), F.lit(after)).alias("after")))


def claims_best(text: Column) -> Column:
    """Whether a claim stands in a clause without a comparison or negation before it."""
    clause = lambda s: F.element_at(F.split(s["before"], LOOSE + CLAUSE), -1)
    return F.when(F.coalesce(text, F.lit("")).rlike(LOOSE + BEST), F.exists(surroundings(text, BEST, BEFORE, 0), lambda s: ~clause(s).rlike(LOOSE + UNLIKE))).otherwise(False)


def numbers(text: Column) -> Column:
    """The unsigned numbers of a text that do not continue a word or another number, rounded to six places."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d+(?:,\d{3})*(?:\.\d+)?)(?!\d)"), 1), lambda x: F.regexp_replace(x, ",", ""))
    power = F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?[eE][+-]?\d+)(?![\w.])"), 1)
    return F.array_distinct(F.transform(F.concat(plain, power), lambda x: F.round(x.try_cast("double"), 6)))


def stemmed(words: Column) -> Column:
    """Words without a final s, joined with blanks at either end."""
    stems = F.transform(words, lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t))
    return F.concat(F.lit(" "), F.array_join(stems, " "), F.lit(" "))


def benchmark_flags(benchmarks: Column, known: Column, line: Column) -> Column:
    """Flags of results: placeholder names, values and names that the text lacks. A text value that is no number ends the check of its result."""

    def one(t: Column, i: Column) -> Column:
        name, metric = strip(F.coalesce(t["name"], F.lit(""))), strip(F.coalesce(t["metric"], F.lit("")))
        text = F.regexp_replace(strip(t["value_str"]), "%+$", "").try_cast("double")
        value = F.coalesce(t["value_num"], text)
        stop = t["value_str"].isNotNull() & t["value_num"].isNull() & text.isNull()
        at = F.concat(F.lit("bench["), i.cast("string"), F.lit("]"))
        words = tokens(name)
        return F.array_compact(F.array(
            F.when(F.lower(name).isin(*PLACEHOLDERS) | F.lower(metric).isin(*PLACEHOLDERS), F.concat(at, F.lit(" placeholder name/metric"))),
            F.when(~stop & value.isNotNull() & ~F.array_contains(known, F.round(value, 6)), F.concat(at, F.lit(".value not found in text"))),
            F.when(~stop & (F.size(words) > 0) & ~F.contains(line, stemmed(words)), F.concat(at, F.lit(".name not found in text"))),
        ))

    return F.flatten(F.transform(F.coalesce(benchmarks, F.array()), lambda t, i: F.when(t.isNotNull(), one(t, i)).otherwise(F.array().cast("array<string>"))))


def modality_flags(modalities: Column, text: Column, code: Column) -> Column:
    """Flags of modalities without a word of evidence; text needs none."""
    bad = lambda m: F.when(m == "code", ~code)
    lacking = lambda m: bad(m).when(m == "image", ~text.rlike(LOOSE + EVIDENCE["image"])).when(m == "audio", ~text.rlike(LOOSE + EVIDENCE["audio"])).when(m == "video", ~text.rlike(LOOSE + EVIDENCE["video"])).otherwise(False)
    return F.transform(F.filter(F.coalesce(modalities, F.array().cast("array<string>")), lambda m: m.isNotNull() & lacking(m)), lambda m: F.concat(F.lit("modalities: '"), m, F.lit("' lacks textual evidence")))


def category(flag: Column) -> Column:
    pairs = (("placeholder", "placeholder"), (".value", "bench_value"), (".name", "bench_name"), ("modalities", "modality"), ("open_source", "open_source"))
    got = F.when(F.lit(False), F.lit(""))
    for part, name in pairs:
        got = got.when(F.contains(flag, F.lit(part)), name)
    return got.otherwise("other")


def flagged(df: DataFrame) -> DataFrame:
    """df (rec_id, title, abstract, extraction, ...) with flags and sota_regex; what the checks need is in columns of its own."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
    ready = df.withColumn("_t", text).withColumns({"_n": numbers(F.col("_t")), "_l": stemmed(tokens(F.col("_t"))), "_c": F.when(F.col("_t").rlike(LOOSE + r"\bcodes?\b"), surroundings(F.col("_t"), r"\bcodes?\b", AROUND, AROUND))})
    code = F.col("_t").rlike(LOOSE + CODE_PHRASE) | F.coalesce(F.exists("_c", lambda s: ~F.concat(s["before"], F.lit(" \u0001 "), s["after"]).rlike(LOOSE + RELEASE)), F.lit(False))
    e = F.col("extraction")
    released = F.array_compact(F.array(F.when(e["open_source"] & ~F.col("_t").rlike(LOOSE + OPEN_SOURCE), "open_source=true without textual evidence")))
    flags = F.concat(benchmark_flags(e["benchmarks"], F.col("_n"), F.col("_l")), modality_flags(e["modalities"], F.col("_t"), code), released)
    made = ready.withColumn("flags", F.when(e.isNotNull(), flags).otherwise(F.array().cast("array<string>"))).withColumn("sota_regex_now", claims_best(F.col("_t")))
    return made.drop("_t", "_n", "_l", "_c")


def grounding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flagged(table(spark, sf_dir, "distilled").select("rec_id", "title", "abstract", "extraction"))
    return d.select("rec_id", "flags", "sota_regex_now", (F.col("extraction.claims_sota") != F.col("sota_regex_now")).alias("disagrees"))


def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by category (flags are counted, not rows)."""
    return grounding_flags(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy(category(F.col("flag")).alias("category")).agg(F.count("*").alias("n_flags"))


def stored_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags stored with the training rows, by category."""
    flags = table(spark, sf_dir, "distilled").select(F.explode("grounding_flags").alias("flag")).where("flag IS NOT NULL")
    return flags.groupBy(category(F.col("flag")).alias("category")).agg(F.count("*").alias("n_flags"))


STORED_SQL = """
SELECT CASE WHEN contains(flag, 'placeholder') THEN 'placeholder' WHEN contains(flag, '.value') THEN 'bench_value' WHEN contains(flag, '.name') THEN 'bench_name' WHEN contains(flag, 'modalities') THEN 'modality'
 WHEN contains(flag, 'open_source') THEN 'open_source' ELSE 'other' END AS category, count(*) AS n_flags FROM (SELECT unnest(grounding_flags) AS flag FROM distilled) WHERE flag IS NOT NULL GROUP BY 1
"""
