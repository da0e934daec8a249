"""p1 (interval labels) and p4 (units) against brute force and labelled cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import unitparse
from millrace.functions.lexicon import Automaton, Resolver, Trie
from millrace.operators import nested, units

RECORD = {
    "extraction": json.dumps({"benchmarks": [None, {"name": "A", "results": {"value": 1}}, {"results": [None, {"value": 2}, {"value": 3}]}]}),
    "grounding_flags": "one", "id": "x",
}


def test_intervals_nest_and_every_node_has_one_parent():
    got = nested.label(nested.record_of(json.dumps(json.dumps(RECORD))))
    spans = [(n[4], n[5]) for n in got]
    assert sorted(x for s in spans for x in s) == list(range(2 * len(got)))
    for pre, post in spans[1:]:
        around = [s for s in spans if s[0] < pre and post < s[1]]
        assert around and all(a[0] < b[0] and b[1] < a[1] for a, b in zip(around, around[1:]))


def test_deep_nesting_needs_no_recursion():
    record: dict = {}
    at = record
    for _ in range(5000):
        at["a"] = {}
        at = at["a"]
    assert len(nested.label(record)) == 5001


def brute(payload):
    record, out = nested.record_of(payload), set()
    if record is None:
        return out
    as_list = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    extraction = nested.opened(record.get("extraction"))
    if isinstance(extraction, dict):
        for i, b in enumerate(as_list(nested.opened(extraction.get("benchmarks")))):
            if b is not None:
                out.add(f"benchmarks[{i}]")
                out |= {f"benchmarks[{i}].results[{j}]" for j, x in enumerate(as_list(b.get("results"))) if x is not None} if isinstance(b, dict) else set()
    return out | {f"grounding_flags[{i}]" for i, x in enumerate(as_list(record.get("grounding_flags"))) if x is not None}


def test_p1_against_brute_force(spark, small):
    got = nested.p1_found(spark, small).where("tab = 'raw_records'").collect()
    want = {(r["raw_id"], p) for r in spark.read.parquet(f"{small}/raw_records.parquet").collect() for p in brute(r["payload"])}
    assert len(got) == len(want) > 0 and {(r["parent_key"], r["path"]) for r in got} == want


def test_p1_edge_cases(spark):
    rows = [(1, json.dumps(RECORD), "extra"), (2, None, "x"), (3, "", "x"), (4, "[]", "x"), (5, "{'id': 1", "x"), (6, "null", "x"), (1, json.dumps(RECORD), "extra")]
    df = spark.createDataFrame(rows, "raw_id bigint, payload string, tab string")
    got = nested.nodes(df, "t", "raw_id", "payload")
    assert got.where(F.col("type") == nested.RESULT).count() == 2 * 3 and {r["parent_key"] for r in got.collect()} == {1}
    assert nested.nodes(df.limit(0), "t", "raw_id", "payload").count() == 0


METRICS = [
    {"ref_id": 201, "canonical": "accuracy", "aliases": ["acc"], "family": "score", "common_unit": "%"}, {"ref_id": 203, "canonical": "macro F1", "aliases": [], "family": "score", "common_unit": "%"},
    {"ref_id": 204, "canonical": "micro F1", "aliases": None, "family": "score", "common_unit": "%"}, {"ref_id": 217, "canonical": "latency", "aliases": [None], "family": "latency", "common_unit": "ms"},
    {"ref_id": 224, "canonical": "perplexity", "aliases": ["PPL"], "family": "ppl", "common_unit": None},
]


@pytest.mark.parametrize("family, common, metric, num, text, source, value, other", [
    ("score", "%", "accuracy", 0.5, None, None, 50, True), ("score", "%", "accuracy", 0.5, None, 1.0, 0.5, False), ("score", "%", "accuracy (%)", 0.5, None, 100.0, 0.5, False),
    ("score", "%", "accuracy", None, "≈ 0.5167 of 1", None, 51.67, True), ("score", "%", "acc", None, "4,902 basis points", None, 49.02, True), ("score", "%", "acc", None, "42.41±0.42 percent", None, 42.41, False),
    ("latency", "ms", "latency", None, "1:02 (m:s)", None, 62000, True), ("latency", "ms", "latency (s)", None, "12 ms", None, 12, False), ("latency", "ms", "latency", None, "1 min 1 s", None, 61000, True),
    ("size", "million parameters", "model size", None, "0.5B", None, 500, True), ("size", "million parameters", "model size, bn", 2.0, None, None, 2000, True), ("size", "million parameters", "#params", None, "900 M params", None, 900, False),
    ("throughput", "tokens/s", "throughput per minute, tokens", 120.0, None, None, 2, True), ("throughput", "tokens/s", "throughput", None, "0.5k tokens/s", None, 500, True), ("throughput", "tokens/s", "x", None, "160.2 tps", None, 160.2, False),
    ("memory", "GB", "peak memory", None, "5 GiB", None, 5.36870912, True), ("energy", "kWh", "energy use (MJ)", 36.0, None, None, 10, True), ("energy", "kWh", "energy", None, "21,860 Wh", None, 21.86, True),
    ("context", "tokens", "context length", None, "200±2k tokens", None, 200000, True), ("duration", "h", "training time in minutes", 90.0, None, None, 1.5, True),
])
def test_p4_conversions(family, common, metric, num, text, source, value, other):
    got = unitparse.convert(family, common, metric, num, text, source)
    assert got is not None and math.isclose(got[0], value, rel_tol=1e-9) and got[1] is other


@pytest.mark.parametrize("text", ["N/A", "", "see text", "-", "tba"])
def test_p4_placeholders(text):
    assert unitparse.convert("score", "%", "accuracy", None, text, None) is None


def test_p4_edge_cases(spark):
    schema = "triple_id bigint, source string, metric string, value_num double, value_str string, unit string"
    rows = [(1, None, "accuracy", 0.4, None, "a"), (1, None, "accuracy", 0.4, None, "a"), (2, "s", None, 1.0, None, "a"), (3, "s", "acc", None, None, "a"), (4, "s", "PPL", 3.0, None, "a"),
            (5, "s", "latency", float("nan"), None, "a"), (6, "s", "latency", None, "9" * 4000, "a"), (7, "b", "accuracy", 0.4, None, "a")]
    source = [{"source": "b", "family": "score", "unit": None, "note": "Percentages throughout."}]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["triple_id"], r["value_common"], r["restated"]) for r in units.converted(df, METRICS, source).collect())
    assert got == [(1, 40.0, True), (1, 40.0, True), (7, 0.4, False)]
    assert units.converted(df.limit(0), METRICS, source).count() == 0


def test_automaton_finds_what_the_full_table_finds():
    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                n = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
                rows[i].append(min(n, rows[i - 2][j - 2] + 1) if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else n)
        return rows[-1][-1]

    words = ["kestrel", "kestrol", "kserstel", "pestrel", "kes", "estrelk", "kesrtel", "kestrelkestrel"]
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for w in words:
        for most in (1, 2, 3):
            assert sorted((n, p) for n, _, p in trie.within(w, most)) == sorted((distance(w, x), x) for x in words if distance(w, x) <= most)
    assert not Automaton("abc", 1).alive(Automaton("abc", 1).step(Automaton("abc", 1).step(Automaton("abc", 1).step(Automaton("abc", 1).start(), "x"), "y"), "z"))


def test_resolver_nulls_and_ties():
    r = Resolver(METRICS)
    assert [r.find(x) for x in (None, "", "  ", "ACC.", "accruacy (%)", "mаcro F1", "mbcro F1")] == [0, 0, 0, 201, 201, 203, 0]
