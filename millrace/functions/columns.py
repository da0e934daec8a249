"""Column builders: tokens, similarity, matching, actions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Unicode has them.
BLANK = "(?U)\\s"
NUMBER = "[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?"
# Thresholds of matching, and metric spellings that count as one.
PAIR, NAME, METRIC, RELATIVE, ABSOLUTE = 0.35, 0.85, 0.85, 0.005, 1e-4
METRIC_GROUPS = [
    ["acc", "accuracy", "top1", "top1acc", "top1accuracy", "avgacc", "averageaccuracy"],
    ["em", "exactmatch", "exactmatchscore"],
    ["f1", "f1score", "microf1", "macrof1"],
    ["bleu", "bleu4", "bleuscore"],
    ["rouge", "rouge1", "rouge2", "rougel", "rougescore"],
    ["pass@1", "passat1", "pass1"],
    ["ppl", "perplexity"],
    ["auc", "auroc", "rocauc"],
    ["mrr", "meanreciprocalrank"],
    ["ndcg", "ndcg@10", "ndcgat10"],
    ["wer", "worderrorrate"],
    ["mmluscore", "mmluacc"],
]


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end (trim() knows only U+0020)."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text; [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def ngrams(words: Column, n: int) -> Column:
    """The different runs of n words as text; all words as one run if there are fewer; [] for none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < n, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))


def keyed(seed: int, key: Column) -> Column:
    """A 60-bit number from seed and key, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def normal_name(c: Column) -> Column:
    """Lower case without blanks, hyphens, underscores, points and slashes; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "(?U)[\\s\\-_./\\\\]+", "")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal normal names, 0 if one is empty, else 1 less edits over the longer length."""
    return closeness(normal_name(a), normal_name(b))


def parsed(num: Column, text: Column) -> Column:
    """The finite number of a value: a number as it is, a text's first number with commas left out; else null."""
    first = F.regexp_extract(F.regexp_replace(text, ",", ""), NUMBER, 0)
    x = F.coalesce(num, F.when(first != "", first).try_cast("double"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def shown(num: Column, text: Column) -> Column:
    return F.coalesce(num.cast("string"), text, F.lit("None"))


def scaled(p: Column, g: Column) -> tuple[Column, Column]:
    """p and g with the one that is a percentage divided by 100 if the other is a share."""
    small, large = (lambda x: (F.abs(x) > 0) & (F.abs(x) <= 1)), (lambda x: (F.abs(x) > 1) & (F.abs(x) <= 100))
    return F.when(small(g) & large(p), p / 100).otherwise(p), F.when(small(p) & large(g), g / 100).otherwise(g)


def closeness(a: Column, b: Column) -> Column:
    """similarity() of two normal names."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def prepared_value(num: Column, text: Column) -> tuple[Column, Column]:
    """(number or null, normal text) of a value."""
    return parsed(num, text), normal_name(shown(num, text))


def close_values(p: Column, p_text: Column, g: Column, g_text: Column) -> Column:
    """1 less the relative error, on the scale that suits better; texts without a number are compared as texts."""
    one = lambda a, b: F.when(b == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / F.abs(b)))
    return F.when(p.isNull() | g.isNull(), closeness(p_text, g_text)).otherwise(F.greatest(one(p, g), one(*scaled(p, g))))


def hit_values(p: Column, p_text: Column, g: Column, g_text: Column) -> Column:
    """Whether the values agree within ABSOLUTE or RELATIVE on either scale."""
    one = lambda a, b: F.coalesce((F.abs(a - b) <= ABSOLUTE) | ((b != 0) & (F.try_divide(F.abs(a - b), F.abs(b)) <= RELATIVE)), F.lit(False))
    return F.when(p.isNull() | g.isNull(), p_text == g_text).otherwise(one(p, g) | one(*scaled(p, g)))


def value_similarity(p_num: Column, p_text: Column, g_num: Column, g_text: Column) -> Column:
    return close_values(*prepared_value(p_num, p_text), *prepared_value(g_num, g_text))


def value_hit(p_num: Column, p_text: Column, g_num: Column, g_text: Column) -> Column:
    return hit_values(*prepared_value(p_num, p_text), *prepared_value(g_num, g_text))


def metric_group(name: Column) -> Column:
    """The number of the group that a normal name of a metric is in, else null."""
    pairs = [F.lit(x) for k, group in enumerate(METRIC_GROUPS) for spelling in group for x in (spelling, k)]
    return F.try_element_at(F.create_map(*pairs), name)


def metric_similarity(a: Column, b: Column) -> Column:
    x, y = normal_name(a), normal_name(b)
    return F.when(metric_group(x) == metric_group(y), 1.0).otherwise(closeness(x, y))


def prepared_names(a: Column) -> Column:
    """Normal names of an array of texts, null elements left out. Put it in a column of its own before pairing."""
    return F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull()), normal_name)


def prepared_triples(a: Column) -> Column:
    """What pairing needs of an array of results, null elements left out. Put it in a column of its own before pairing."""

    def one(t: Column) -> Column:
        number, text = prepared_value(t["value_num"], t["value_str"])
        return F.struct(normal_name(t["name"]).alias("name"), normal_name(t["metric"]).alias("metric"), metric_group(normal_name(t["metric"])).alias("grp"), number.alias("num"), text.alias("text"), (t["value_num"].isNotNull() | t["value_str"].isNotNull()).alias("there"))

    return F.transform(F.filter(F.coalesce(a, F.array()), lambda t: t.isNotNull()), one)


def close_metrics(p: Column, g: Column) -> Column:
    return F.when(p["grp"] == g["grp"], 1.0).otherwise(closeness(p["metric"], g["metric"]))


def triple_similarity(p: Column, g: Column) -> Column:
    """Mean of the similarities of name, metric and value of prepared results; a missing value gives 0 for its part."""
    value = F.when(p["there"] & g["there"], close_values(p["num"], p["text"], g["num"], g["text"])).otherwise(0.0)
    return (closeness(p["name"], g["name"]) + close_metrics(p, g) + value) / 3.0


def triple_hit(p: Column, g: Column) -> Column:
    """Whether name, metric and value of prepared results all agree."""
    return (closeness(p["name"], g["name"]) >= NAME) & (close_metrics(p, g) >= METRIC) & p["there"] & g["there"] & hit_values(p["num"], p["text"], g["num"], g["text"])


def greedy_match(p: Column, g: Column, sim: Callable[[Column, Column], Column], hit: Callable[[Column, Column], Column] | None = None, bar: float = PAIR) -> Column:
    """struct(soft, hard, matched, n_pred, n_gold): F1 of the greedy pairing of two prepared arrays by falling similarity.

    Ties go by place in p, then in g. Each side is used once; pairs below `bar` are not made. Two empty lists score
    1, one empty list 0.
    """
    make = lambda x, i, y, j: F.struct((-sim(x, y)).alias("s"), i.alias("i"), j.alias("j"), (hit(x, y) if hit else F.lit(False)).alias("h"))
    pairs = F.flatten(F.transform(p, lambda x, i: F.transform(g, lambda y, j: make(x, i, y, j))))
    ranked = F.array_sort(F.filter(pairs, lambda t: t["s"] <= -bar))
    start = F.struct(F.array().cast("array<int>").alias("p"), F.array().cast("array<int>").alias("g"), F.lit(0.0).alias("sum"), F.lit(0).alias("hits"))

    def step(acc: Column, t: Column) -> Column:
        free = ~F.array_contains(acc["p"], t["i"]) & ~F.array_contains(acc["g"], t["j"])
        taken = F.struct(F.concat(acc["p"], F.array(t["i"])).alias("p"), F.concat(acc["g"], F.array(t["j"])).alias("g"), (acc["sum"] + F.least(F.lit(1.0), -t["s"])).alias("sum"), (acc["hits"] + t["h"].cast("int")).alias("hits"))
        return F.when(free, taken).otherwise(acc)

    m, n = F.size(p), F.size(g)
    f1 = lambda x: F.when((m == 0) & (n == 0), 1.0).when((m == 0) | (n == 0) | (x <= 0), 0.0).otherwise(2.0 * (x / m) * (x / n) / (x / m + x / n))
    done = lambda a: F.struct(f1(a["sum"]).alias("soft"), f1(a["hits"].cast("double")).alias("hard"), F.size(a["p"]).alias("matched"), m.alias("n_pred"), n.alias("n_gold"))
    return F.aggregate(ranked, start, step, done)


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of the two sets of normal names; two empty ones score 1."""
    p, g = (F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda e: normal_name(F.coalesce(e, F.lit("None"))))) for x in (pred, gold))
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def until_action(c: Column) -> Column:
    """The text up to its first </search>, else up to its first </answer>."""
    cut = lambda tag: F.concat(F.substring_index(c, tag, 1), F.lit(tag))
    return F.when(F.contains(c, F.lit("</search>")), cut("</search>")).when(F.contains(c, F.lit("</answer>")), cut("</answer>")).otherwise(c)


ACTION = "(?s)<(search|answer)>(.*?)</\\1>"


def action(c: Column) -> Column:
    """struct(kind, content) of the first search or answer; kind null and content '' without one."""
    kind = F.regexp_extract(c, ACTION, 1)
    return F.struct(F.when(kind != "", kind).alias("kind"), strip(F.regexp_extract(c, ACTION, 2)).alias("content"))


def last_answer(c: Column) -> Column:
    """The content of the last answer, '' without one."""
    return strip(F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit("(?s)<answer>(.*?)</answer>"), 1), F.lit(-1)), F.lit("")))
