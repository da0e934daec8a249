"""Cases of the operators of curation, matching, reward, retrieval, grounding, rollout, sources and streams."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import jsontext as J
from millrace.operators import curate, decontam, evaluate, grounding, retrieval, rollout, stats
from millrace.sources import jsonl, model, oai
from millrace.streaming import resume

TRIPLE = "struct<name:string,metric:string,value_num:double,value_str:string>"


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, kind(v)) for k, v in values.items())))
    return df.select(column.alias("x")).first()["x"]


def kind(v):
    return {float: "double", int: "int", bool: "boolean", list: "array<string>"}.get(type(v), "string")


def test_tokens_and_grams(spark):
    assert one(spark, C.tokens(F.col("t")), t="GSM-8K, größe!") == ["gsm", "8k", "gr", "e"] and one(spark, C.tokens(F.col("t")), t=None) == []
    assert one(spark, C.ngrams(C.tokens(F.col("t")), 13), t="a b c") == ["a b c"] and one(spark, C.ngrams(C.tokens(F.col("t")), 13), t="") == []
    assert one(spark, C.ngrams(C.tokens(F.col("t")), 2), t="a b a b") == ["a b", "b a"]


@pytest.mark.parametrize("a, b, same", [("GSM8K", "gsm 8k", 1.0), ("GSM-8K", "gsm_8k", 1.0), ("", "", 1.0), ("a", "", 0.0), ("größe", "grosse", 0.5), ("kitten", "sitting", 1 - 3 / 7)])
def test_name_similarity(spark, a, b, same):
    assert math.isclose(one(spark, C.similarity(F.col("a"), F.col("b")), a=a, b=b), same)


@pytest.mark.parametrize("p, g, sim, hit", [("0.853", "85.3", 1.0, True), ("0.5", "0", 0.0, False), ("90", "100", 0.9, False), ("85.31", "85.3", None, True), ("86.0", "85.3", None, False), ("0", "0", 1.0, True), ("N/A", "n/a", 1.0, True), ("1,234.5", "1234.5", 1.0, True), ("85.3%", "85.3", 1.0, True)])
def test_values(spark, p, g, sim, hit):
    none = F.lit(None).cast("double")
    if sim is not None:
        assert math.isclose(one(spark, C.value_similarity(none, F.col("p"), none, F.col("g")), p=p, g=g), sim, abs_tol=1e-12)
    assert one(spark, C.value_hit(none, F.col("p"), none, F.col("g")), p=p, g=g) is hit


def test_metrics_of_one_group(spark):
    assert one(spark, C.metric_similarity(F.col("a"), F.col("b")), a="Acc", b="top-1 accuracy") == 1.0
    assert one(spark, C.metric_similarity(F.col("a"), F.col("b")), a="BLEU", b="WER") < 0.5


def brute_match(p, g, sim, hit):
    """The pairing as loops over all pairs."""
    if not p or not g:
        return (1.0, 1.0) if not p and not g else (0.0, 0.0)
    pairs = sorted(((sim(x, y), i, j) for i, x in enumerate(p) for j, y in enumerate(g)), key=lambda t: (-t[0], t[1], t[2]))
    a, b, total, hits = set(), set(), 0.0, 0
    for s, i, j in pairs:
        if s >= C.PAIR and i not in a and j not in b:
            a.add(i), b.add(j)
            total, hits = total + min(1.0, s), hits + hit(p[i], g[j])
    f1 = lambda x: 0.0 if x <= 0 else 2 * (x / len(p)) * (x / len(g)) / (x / len(p) + x / len(g))
    return f1(total), f1(hits)


def test_greedy_match_against_loops(spark):
    rng = random.Random(4)

    def norm(s):
        return "".join(c for c in (s or "").lower() if c not in " -_./\\")

    def close(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    def value(p, g):
        if p is None or g is None:
            return 0.0
        tried = [(p, g), (p, g / 100) if 0 < abs(p) <= 1 < abs(g) <= 100 else (p / 100, g) if 0 < abs(g) <= 1 < abs(p) <= 100 else (p, g)]
        return max((float(a == 0) if b == 0 else max(0.0, 1 - abs(a - b) / abs(b))) for a, b in tried)

    def near(p, g):
        return any(abs(a - b) <= 1e-4 or b and abs(a - b) / abs(b) <= 0.005 for a, b in [(p, g), (p, g / 100) if 0 < abs(p) <= 1 < abs(g) <= 100 else (p / 100, g) if 0 < abs(g) <= 1 < abs(p) <= 100 else (p, g)])

    groups = {norm(x): k for k, group in enumerate(C.METRIC_GROUPS) for x in group}
    metric = lambda a, b: 1.0 if norm(a) == norm(b) or norm(a) in groups and groups.get(norm(a)) == groups.get(norm(b)) else close(norm(a), norm(b))
    sim = lambda x, y: (close(norm(x[0]), norm(y[0])) + metric(x[1], y[1]) + value(x[2], y[2])) / 3
    hit = lambda x, y: close(norm(x[0]), norm(y[0])) >= 0.85 and metric(x[1], y[1]) >= 0.85 and x[2] is not None and y[2] is not None and near(x[2], y[2])
    make = lambda: [(rng.choice(["GSM8K", "gsm-8k", "MMLU", "SQuAD v1.1", "", None]), rng.choice(["acc", "accuracy", "EM", "F1", "x"]), rng.choice([None, 0.0, 0.853, 85.3, 85.31, 90.0]), None) for _ in range(rng.randint(0, 5))]
    rows = [(i, make(), make()) for i in range(120)]
    df = spark.createDataFrame(rows, f"i int, p array<{TRIPLE}>, g array<{TRIPLE}>").select("i", C.prepared_triples(F.col("p")).alias("p"), C.prepared_triples(F.col("g")).alias("g"))
    got = {r["i"]: (r["m"]["soft"], r["m"]["hard"]) for r in df.withColumn("m", C.greedy_match(F.col("p"), F.col("g"), C.triple_similarity, C.triple_hit)).collect()}
    for i, p, g in rows:
        want = brute_match(p, g, sim, hit)
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[i], want)), (p, g, got[i], want)


def test_set_f1(spark):
    assert one(spark, C.set_f1(F.col("a"), F.col("b")), a=["Text", "image"], b=["text"]) == pytest.approx(2 / 3)
    assert one(spark, C.set_f1(F.col("a"), F.col("b")), a=[], b=[]) == 1.0


def test_actions(spark):
    assert one(spark, C.until_action(F.col("t")), t="a<answer>x</answer>b<search>q</search>c") == "a<answer>x</answer>b<search>q</search>"
    assert tuple(one(spark, C.action(F.col("t")), t="<search> a\nb \n</search><answer>x</answer>")) == ("search", "a\nb") and tuple(one(spark, C.action(F.col("t")), t="none")) == (None, "")
    assert one(spark, C.last_answer(F.col("t")), t="<answer>1</answer><answer>\n2 </answer>") == "2" and one(spark, C.last_answer(F.col("t")), t="x") == ""


GOOD = {"task_type": "other", "modalities": ["text"], "benchmarks": [], "open_source": False, "claims_sota": False, "method_keywords": ["a", "b", "c"], "one_line_summary": "s", "limitation_mentioned": None}


def changed(**kw):
    return json.dumps({k: v for k, v in (GOOD | kw).items() if v != "drop"})


@pytest.mark.parametrize("text, gate, status", [
    (json.dumps(GOOD), None, "VALID"), ("no braces", "no_json", "INVALID"), ("", "no_json", "INVALID"), (None, "no_json", "INVALID"), ('{"a": 1,}', "parse_fail", "INVALID"), (changed(open_source="drop"), "schema_invalid", "INVALID"),
    (changed(extra=1), "schema_invalid", "INVALID"), (changed(task_type="sleep"), "schema_invalid", "INVALID"), (changed(task_type=" Other "), None, "VALID"), (changed(open_source="yes"), None, "VALID"), (changed(open_source=2), "schema_invalid", "INVALID"),
    (changed(method_keywords=["a", "b"]), None, "SOFT_VIOLATION"), (changed(modalities=[]), None, "SOFT_VIOLATION"), (changed(benchmarks=[{"name": "n", "metric": "m", "value": "85.3"}]), None, "SOFT_VIOLATION"),
    (changed(benchmarks=[{"name": "n", "metric": "m", "value": float("nan")}]), None, "SOFT_VIOLATION"), (changed(benchmarks=[{"name": "n", "metric": "m", "value": True}]), None, "SOFT_VIOLATION"), (changed(benchmarks=[{"name": "n", "metric": "m", "value": 1, "x": 2}]), "schema_invalid", "INVALID"),
    (json.dumps(GOOD)[:-1] + ', "task_type": "other"}', "duplicate_keys", "VALID"), ("{ open " + json.dumps(GOOD), None, "VALID"), ('{"draft": {"a": 1}} ' + json.dumps(GOOD), None, "VALID"), (json.dumps(GOOD) + " {broken}", None, "VALID"), ("[1, 2]", "no_json", "INVALID"),
])
def test_reading(text, gate, status):
    got = J.read(text)
    assert (got["gate"], got["status"]) == (gate, status), got


def test_objects_in_linear_time():
    assert J.objects("{" * 200_000) == [] and J.objects('{"a": "}"} x {"b": {}}') == ['{"a": "}"}', '{"b": {}}']
    assert J.objects('{ "a {"b": 1}') == ['{"b": 1}'] or J.objects('{ "a {"b": 1}') == []


def test_rewards_and_evaluation(spark):
    bench = [{"name": "MMLU", "metric": "acc", "value": 71.5}]
    perfect, wrong = json.dumps(GOOD | {"benchmarks": bench}), json.dumps(GOOD | {"benchmarks": [{"name": "zzzz", "metric": "q", "value": 3}]})
    pred = spark.createDataFrame([(1, "p", "m", perfect), (2, "p", "m", wrong), (3, "p", "m", "junk"), (4, "q", "m", perfect), (5, "p", "m", None)], "pred_id bigint, id string, model string, raw_text string")
    gold = spark.createDataFrame([("p", perfect)], "id string, text string").select("id", evaluate.reading("text")["parsed"].alias("gold"))
    got = {r["pred_id"]: r["reward"] for r in evaluate.rewards(pred, gold).collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(0.25) and got[3] == -1.0 and set(got) == {1, 2, 3, 4} and -1 < got[4] < 1
    say = lambda x: [{"role": "assistant", "content": x}]
    holdout = spark.createDataFrame([("a", 1, say(perfect)), ("b", 2, say(perfect)), ("c", 3, say(perfect)), ("d", 4, say("bad")), ("e", 5, None)], "id string, rec_id bigint, messages array<struct<role:string,content:string>>")
    outputs = spark.createDataFrame([("a", 1, "junk", None), ("a", 2, perfect, None), ("b", 3, "noise " + wrong, None)], f"id string, pred_id bigint, raw_text string, extraction {evaluate.EXTRACTION}")
    golds = evaluate.gold_of_messages(holdout)
    s = {r["id"]: r for r in evaluate.paper_scores(outputs, golds).collect()}
    assert set(s) == {"a", "b", "c"} and s["a"]["overall"] == 1.0 and s["c"]["overall"] == 0.0 and not s["c"]["valid"] and s["b"]["benchmarks_hard"] == 0.0


def test_bootstrap(spark):
    values = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.7).alias("c"))
    got = {r["field"]: r for r in evaluate.bootstrap(values, "x", "c", draws=400).collect()}
    assert got["c"]["lo"] == got["c"]["hi"] == 0.7 and 0.42 < got["x"]["lo"] < 0.5 < got["x"]["hi"] < 0.58
    assert [r["mean"] for r in evaluate.bootstrap(values.limit(0), "x").collect()] == [0.0]


def test_curation(spark):
    rows = [("a", 1, "old", "cs.CL"), ("a", 2, "new", "cs.AI cs.CL"), (None, 3, None, None)]
    df = spark.createDataFrame(rows, "id string, ingest_seq int, abstract string, categories string")
    assert {(r["id"], r["abstract"]) for r in curate.latest(df, "id", "ingest_seq").collect()} == {("a", "new"), (None, None)}
    assert {(r["id"], r["abstract"]) for r in curate.first(df, "id", "ingest_seq").collect()} == {("a", "old"), (None, None)}
    ids = {"2506.99999": 2506, "2507.00001": 2507, "1306.1870": 1306, "cs/0701001": None}
    assert {k: one(spark, curate.yymm(F.col("i")), i=k) for k in ids} == ids
    texts = {"85.3 and 0.91": True, "12% and 7.5%": True, "12 and 2025": False, None: False}
    assert {k: one(spark, curate.numeric_signal(F.col("t")), t=k) for k in texts} == texts
    assert curate.quotas(80, 80, 100, 0.5) == (50, 50) and curate.quotas(10, 80, 50, 0.6) == (10, 40) and curate.quotas(80, 5, 50, 0.5) == (45, 5)
    pool = spark.range(500).select(F.col("id").cast("string").alias("id"))
    some = [r["id"] for r in curate.lowest(pool, 123, 5).collect()]
    assert len(set(some)) == 123 and set(some) == {r["id"] for r in curate.lowest(pool, 123, 5).collect()} and curate.lowest(pool, 999, 5).count() == 500 and curate.lowest(pool.limit(0), 3, 5).count() == 0
    held, rest = curate.split(pool, 40)
    assert held.count() == 40 and rest.count() == 460 and held.intersect(rest).count() == 0
    with pytest.raises(ValueError):
        curate.split(pool.limit(10), 10)
    assert {r["id"] for r in curate.remaining(df, df.where("id = 'a'")).collect()} == {None}


def test_decontamination(spark):
    line = " ".join(f"w{i}" for i in range(14))
    train = spark.createDataFrame([(1, line + " x y"), (2, "other words entirely"), (3, "short"), (4, None)], "k int, t string")
    against = spark.createDataFrame([(7, line + " q"), (6, "short")], "k int, t string")
    a, b = (decontam.grams(df, "k", F.col("t")).withColumnRenamed("k", name) for df, name in ((train, "train_id"), (against, "against_id")))
    for most in (1000, 1):  # the held-out side broadcast, and shuffled
        assert sorted(map(tuple, decontam.contaminated(a, b, most).collect())) == [(1, 7, 2), (3, 6, 1)]


def test_retrieval(spark, tmp_path):
    papers = spark.createDataFrame([(1, "a", "alpha beta", "beta"), (2, "b", "gamma", "beta delta"), (3, "c", None, " \n"), (4, "d", "delta", "delta"), (5, "e", "zeta", None), (6, "f", "eta", None)], "seq int, id string, title string, abstract string")
    index = retrieval.Index.build(papers)
    index.save(str(tmp_path / "index"))
    index = retrieval.Index.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "delta", None), (2, "delta", "d"), (3, "!!", None), (4, "beta beta", None)], "qid int, text string, exclude_id string")
    got = {}
    for r in index.search(asked, 3).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {1: ["d", "b", "a"], 2: ["b", "a", "e"], 4: ["a", "b", "d"]}
    docs = {1: "alpha beta beta", 2: "gamma beta delta", 4: "delta delta", 5: "zeta", 6: "eta"}
    n, mean = len(docs), sum(len(d.split()) for d in docs.values()) / len(docs)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w in set(" ".join(docs.values()).split()) for k in [sum(w in d.split() for d in docs.values())]}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = idf["delta"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / mean))
    assert index.search(asked.where("qid = 1"), 1).first()["score"] == pytest.approx(want, abs=1e-4)
    text = {r["qid"]: r["text"] for r in retrieval.passages(index.search(asked.where("qid = 1"), 2), papers).collect()}
    assert text[1] == "Doc 1(Title: delta) delta\nDoc 2(Title: gamma) beta delta"
    with pytest.raises(ValueError):
        retrieval.Index.build(papers.where("seq = 3"))


@pytest.mark.parametrize("text, claim", [
    ("comparable to SOTA on X, and achieves state-of-the-art on Y", True), ("It does not outperform all", False), ("not only simpler, but also achieves state-of-the-art", True), ("Our approach achieves state-of-the-art", False), ("a new SOTA", True), ("plain", False), (None, False), ("sets the previous best; matches SOTA", True),
])
def test_claims(spark, text, claim):
    assert one(spark, grounding.claims_best(F.col("t")), t=text) is claim


def test_grounding(spark):
    e = {"task_type": "other", "modalities": ["text", "image", "code"], "benchmarks": [{"name": "DocVQA", "metric": "acc", "value_num": 72.4, "value_str": None}, {"name": "Nowhere", "metric": "acc", "value_num": 2.5, "value_str": None}, {"name": "n/a", "metric": "x", "value_num": None, "value_str": "high"}, None],
         "open_source": True, "claims_sota": False, "method_keywords": [], "one_line_summary": "", "limitation_mentioned": None}
    schema = f"rec_id int, title string, abstract string, extraction {evaluate.EXTRACTION}"
    df = spark.createDataFrame([(1, "Qwen2.5 on scans", "It reaches 72.4 on DocVQAs. The code is available at our site.", e), (2, None, None, None), (3, "SQL", "images, scan", e | {"open_source": False, "benchmarks": None})], schema)
    got = {r["rec_id"]: r["flags"] for r in grounding.flagged(df).collect()}
    assert got[1] == ["bench[1].value not found in text", "bench[1].name not found in text", "bench[2] placeholder name/metric", "modalities: 'code' lacks textual evidence"] and got[2] == [] and got[3] == []
    cats = [one(spark, grounding.category(F.col("f")), f=f) for f in (*got[1], "open_source=true without textual evidence", "?")]
    assert cats == ["bench_value", "bench_name", "placeholder", "modality", "open_source", "other"]


def test_statistics(spark):
    df = spark.createDataFrame([("g", 1.0, "a"), ("g", 3.0, "b"), ("h", 2.0, "a"), (None, 5.0, "a"), ("g", None, None)], "g string, v double, t string")
    got = sorted((r["g"], r["v"], r["advantage"]) for r in stats.advantages(df.where("v IS NOT NULL"), "g", "v").collect() if r["g"] == "g")
    assert got[0][2] == pytest.approx(-1 / (math.sqrt(2) + 1e-4)) and got[1][2] == pytest.approx(1 / (math.sqrt(2) + 1e-4))
    assert stats.advantages(df.where("g = 'h'"), "g", "v").first()["advantage"] is None
    assert {r["g"]: r["bits"] for r in stats.entropy(df.where("g IS NOT NULL"), "g", "t").collect()} == {"g": 1.0, "h": 0.0}
    assert one(spark, stats.penalty(F.col("a"), F.col("s"), F.col("i")), a=True, s=0, i=2) == pytest.approx(1.0) and one(spark, stats.penalty(F.col("a"), F.col("s"), F.col("i")), a=False, s=1, i=0) == pytest.approx(0.3)
    rows = spark.createDataFrame([(1, [{"role": "user", "content": "a b c"}, {"role": "assistant", "content": "d e"}, None, {"role": "user", "content": "f g"}])], "k int, messages array<struct<role:string,content:string>>")
    segs = stats.segments(rows, "k", budget=6)
    assert [(r["kept"], r["mask"]) for r in segs.orderBy("seg").collect()] == [(3, 0), (2, 1), (1, 0)] and stats.mask_arrays(segs, "k", 8).first()["mask"] == [0, 0, 0, 1, 1, 0, 0, 0]


def test_rollout(spark):
    run = lambda texts, **kw: rollout.replay([(t, "P") for t in texts], kw.get("max_turns", 3), kw.get("budget", 10_000), 400, rollout.letters)
    segs, state = run(["<search>q</search>", "<answer>a</answer>", "x"])
    assert [s[3] for s in segs] == [1, 0, 1] and state == {"turns": 2, "valid_actions": 2, "searches": 1, "answered": True, "invalid_actions": 0} and segs[1][1] == "\n\n<information>P</information>\n\n"
    segs, state = run(["junk", "<answer>a</answer>"])
    assert [s[3] for s in segs] == [1, 0, 1] and state["invalid_actions"] == 1 and segs[1][1] == rollout.HINT
    _, state = run(["<search>q</search>"] * 5)
    assert state == {"turns": 4, "valid_actions": 3, "searches": 3, "answered": False, "invalid_actions": 0}
    assert sum(s[2] for s in run(["<search>q</search>"] * 5, budget=30)[0]) == 30
    papers = spark.createDataFrame([(1, "a", "alpha", "beta"), (2, "b", "gamma", "beta")], "seq int, id string, title string, abstract string")
    turns = spark.createDataFrame([("t", 0, "<search>gamma</search> made up", "a"), ("t", 1, "<answer>{}</answer>", "a"), ("u", 0, "<search>!!</search>", None)], "traj_id string, turn int, text string, exclude_id string")
    steps = rollout.observed(turns, retrieval.Index.build(papers), papers, 1)
    got = rollout.replayed(steps).orderBy("traj_id", "seg").collect()
    assert [(r["traj_id"], r["owner"], r["mask"]) for r in got] == [("t", "model", 1), ("t", "environment", 0), ("t", "model", 1), ("u", "model", 1), ("u", "environment", 0)]
    assert got[0]["text"] == "<search>gamma</search>" and "Doc 1(Title: gamma) beta" in got[1]["text"] and rollout.NOTHING in got[4]["text"] and got[0]["answered"] and not got[4]["answered"]
    assert rollout.padded([[1, 2], [3]], 0) == [[1, 2], [3, 0]] and rollout.padded([[1, 2], [3]], 0, left=True) == [[1, 2], [0, 3]]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    Path(path).write_text('{"id": "a", "x": 1}\n\n{broken\n{"id": "a", "x": 2}\n{"id": 7, "x": 3}\n')
    schema = "id string, x int"
    assert tuple(jsonl.counts(spark, path, schema).first()) == (4, 3)
    assert {(r["id"], r["x"]) for r in jsonl.keyed(spark, path, schema).collect()} == {("a", 2), ("7", 3)}
    with pytest.raises(Exception):  # noqa: B017
        jsonl.strict(spark, path, schema).collect()
    Path(tmp_path / "black.txt").write_text("a  b\nc a\n")
    assert {r["id"] for r in jsonl.listed(spark, str(tmp_path / "black.txt")).collect()} == {"a", "b", "c"} and jsonl.listed(spark, str(tmp_path / "none.txt")).count() == 0
    out = str(tmp_path / "out")
    jsonl.append(spark.createDataFrame([("a", 1), ("b", 2)], schema), out)
    jsonl.replace(spark.read.schema(schema).json(out).where("x = 2"), out)
    assert [tuple(r) for r in spark.read.schema(schema).json(out).collect()] == [("b", 2)]
    jsonl.routed(spark.createDataFrame([("a", 1), ("b", None)], schema), F.col("x") > 0, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "ok")).count() == spark.read.json(str(tmp_path / "bad")).count() == 1
    jsonl.report(spark.createDataFrame([("a", 1)], schema), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["x"] == 1
    Path(tmp_path / "log").write_text("{'loss': 0.5, 'epoch': 0.1}\nother\n{'loss': 0.25, 'epoch': 0.2}\n")
    assert [(round(r["step"], 1), r["loss"]) for r in jsonl.losses(spark, str(tmp_path / "log")).collect()] == [(108.1, 0.5), (216.2, 0.25)]


def page(records, token=""):
    body = "".join(f"<record><header/><metadata><arXiv xmlns='http://arxiv.org/OAI/arXiv/'><id>{i}</id><title> A\n  {i} </title><categories>cs.CL</categories></arXiv></metadata></record>" if i else "<record><header status='deleted'/></record>" for i in records)
    return f"<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><ListRecords>{body}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"


def test_pages_and_stream(spark, tmp_path):
    assert oai.parse("<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><error code='noRecordsMatch'/></OAI-PMH>") == ([], None)
    with pytest.raises(ValueError):
        oai.parse("<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><error code='badArgument'>x</error></OAI-PMH>")
    rows, token = oai.parse(page(["1", "", "2"], "t2"))
    assert [(r[0], r[3], r[4]) for r in rows] == [("1", "A 1", ""), ("2", "A 2", "")] and token == "t2"
    assert oai.parsed(spark.createDataFrame([(page(["5"]),), (None,)], "page string")).count() == 1
    fails = iter([OSError(), None])
    assert oai.patient(lambda t: t if (e := next(fails)) is None else (_ for _ in ()).throw(e), "x", wait=0) == "x"
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page-start.xml").write_text(page(["1", "2"], "t2"))
    (pages / "page-t2.xml").write_text(page(["2", "3"]))
    spark.dataSource.register(oai.OaiPages)
    assert spark.read.format("oai_pages").load(str(pages)).count() == 4
    # A stream that is run twice from its checkpoint appends every id once.
    source, sink = tmp_path / "source", str(tmp_path / "sink")
    for k, ids in enumerate((["1", "2", "2"], ["2", "3"])):
        spark.createDataFrame([(i, k) for i in ids], "id string, k int").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, k int").parquet(str(source))
        resume.append_new(stream, sink, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r["id"], r["k"]) for r in spark.read.parquet(sink).collect()) == [("1", 0), ("2", 0), ("3", 1)]


def test_stream_of_pages(spark, tmp_path):
    (tmp_path / "page-start.xml").write_text(page(["1", "2"], "t2"))
    (tmp_path / "page-t2.xml").write_text(page(["2", "3"]))
    spark.dataSource.register(oai.OaiPages)
    q = spark.readStream.format("oai_pages").load(str(tmp_path)).writeStream.format("memory").queryName("oai_rows").start()
    try:
        q.processAllAvailable()
        assert sorted(r["id"] for r in spark.table("oai_rows").collect()) == ["1", "2", "2", "3"]
    finally:
        q.stop()


def test_batch_stats_stream(spark, tmp_path):
    rows = [("2025-01-01 00:10:00", 1.0, None), ("2025-01-01 00:20:00", -1.0, "no_json"), ("2025-01-01 05:00:00", 0.5, None)]
    spark.createDataFrame(rows, "ts string, reward double, gate string").select(F.to_timestamp("ts").alias("ts"), "reward", "gate").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, reward double, gate string").parquet(str(tmp_path / "in"))
    q = resume.batch_stats(stream).writeStream.outputMode("complete").format("memory").queryName("stats_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["reward_mean"], r["gate_rate"]) for r in spark.table("stats_rows").collect()) == [(1, 0.5, 0.0), (2, 0.0, 0.5)]


def test_labels_with_retry(spark):
    good = json.dumps(GOOD)

    def call(asked, temperature):
        return [good if "fine" in a or temperature > 0 and "later" in a else "junk" for a in asked]

    df = spark.createDataFrame([(1, "fine", "x"), (2, "later", "x"), (3, "never", None)], "k int, title string, abstract string").withColumn("prompt", model.prompts("Do it.", [("u", "a")]))
    got = {r["k"]: (r["r"]["status"], r["raw"] == good, r["temperature"]) for r in model.labelled(df, "k", "prompt", call).collect()}
    assert got == {1: ("VALID", True, 0.0), 2: ("VALID", True, 0.6), 3: ("INVALID", False, 0.0)}
