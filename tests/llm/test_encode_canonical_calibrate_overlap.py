"""p5 to p8 against libraries, brute force and edge cases."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
from millrace.functions.words import words  # noqa: E402
from millrace.llm import calibrate, canonical, encode, overlap  # noqa: E402

# p8


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encode.vocabulary(), special_tokens={})


def test_p8_equals_the_library_and_decodes_back(spark, small):
    own, other = encode.Encoder(), library()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in encode.p8_ids(spark, small).collect()}
    assert got == {k: other.encode_ordinary(t) if t else [] for k, t in texts.items()}
    assert all(own.decode(got[k]) == (t or "") for k, t in texts.items())


@pytest.mark.parametrize("text", ["aaaaaaaaaaaa" * 300, "<|endoftext|>", " \n\t ", "กขค" * 200, "é é", "👩‍🔬🚀", "a" * 9 + "ab" * 50, "1234567890" * 40, "x\r\n\r\ny"])
def test_p8_hard_texts(text):
    own = encode.Encoder()
    assert own.encode(text) == library().encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_p8_edge_cases(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "", [1]), (3, "ab", [1]), (3, "ab", [1])], "doc_id bigint, text string, ids array<int>")
    got = [(r["doc_id"], list(r["ids"])) for r in encode.encoded(df, "doc_id", "text").collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [397]), (3, [397])]
    assert encode.encoded(df.limit(0), "doc_id", "text").count() == 0


# p6

ENTRIES = [
    {"ref_id": 4, "kind": "name", "canonical": "VexCode v1.0", "aliases": ["Vex Coding Tasks 1"]}, {"ref_id": 5, "kind": "name", "canonical": "VexCode v2.0", "aliases": None},
    {"ref_id": 207, "kind": "metric", "canonical": "pass@1", "aliases": ["pass at 1"]}, {"ref_id": 208, "kind": "metric", "canonical": "pass@10", "aliases": [None]},
]


def test_p6_edge_cases(spark):
    rows = [(1, "VexCode v1.0", None, 9), (2, "vexcoed v2.0 (test)", "pass @ 10 (bp)", 9), (2, "vexcoed v2.0 (test)", "pass @ 10 (bp)", 9), (3, " ", "pass@5", 9), (4, "Tasks 1, Vex Coding", "x" * 5000, 9), (5, None, None, 9)]
    df = spark.createDataFrame(rows, "triple_id bigint, name string, metric string, ref_id int")
    got = sorted((r["triple_id"], r["field"], r["ref_id"]) for r in canonical.mapped(df, ENTRIES).collect())
    assert got == [(2, "metric", 208), (2, "metric", 208), (2, "name", 5), (2, "name", 5), (3, "metric", 0), (4, "metric", 0), (4, "name", 4)]
    assert canonical.mapped(df.limit(0), ENTRIES).count() == 0


def test_p6_planted_typos(spark, small):
    """Every entry with letters exchanged, left out or doubled comes back to itself."""
    ref = [r.asDict() for r in spark.read.parquet(f"{small}/ref_items.parquet").collect()]
    names = canonical.Resolver([r for r in ref if r["kind"] == "name"])
    for r in ref:
        c = r["canonical"]
        if r["kind"] == "name" and len(c) > 9:
            for typo in (c[:3] + c[4] + c[3] + c[5:], c[:4] + c[5:], c[:5] + c[4] + c[5:], c.upper() + " (test)", f"the {c} dev", c.replace("a", "а")):
                assert names.find(typo) == r["ref_id"], typo


# p7


def test_p7_newton_meets_any_margins():
    rng = np.random.default_rng(1)
    papers = rng.integers(20, 400, 12).astype(float)
    x = np.hstack([np.kron(np.eye(6), np.ones((2, 1))), np.kron(np.ones((6, 1)), [[1], [0]])])
    aim = papers * rng.uniform(0.1, 0.5, 12)
    p = calibrate.tilt(papers, aim, int(aim.sum()), x)
    assert np.abs(x.T @ (papers * p - aim)).max() < 1e-6 and (p <= 1).all()


def test_p7_pivotal_keeps_sums_and_probabilities():
    units = [(str(i), 0.3) for i in range(10)]
    counts = Counter()
    for seed in range(3000):
        drawn, left = calibrate.pivotal(units, seed)
        assert len(drawn) == 3 and (left is None or left[-1] < 1e-6)
        counts.update(u[0] for u in drawn)
    assert all(abs(counts[str(i)] / 3000 - 0.3) < 0.04 for i in range(10))


def test_p7_sample_follows_the_report(spark, small):
    report = {(r["category"], r["numeric_flag"]): r for r in calibrate.p7_report(spark, small).collect()}
    drawn = calibrate.p7_sample(spark, small).collect()
    assert len({r["id"] for r in drawn}) == len(drawn)
    counts = Counter((r["category"], r["numeric_flag"]) for r in drawn)
    assert all(abs(counts[k] - r["aim"]) <= 1 for k, r in report.items())
    assert {(r["category"], r["numeric_flag"]) for r in calibrate.p7_found(spark, small).collect()} == {k for k, r in report.items() if r["short"]}


def test_p7_edge_cases(spark):
    schema = "id string, ingest_seq bigint, categories string, numeric_signal boolean, probability int"
    rows = [("a", 1, "cs.LG", True, 0), ("a", 2, "CS.lg;x", False, 0), (None, 3, "cs.LG", True, 0), ("b", 4, None, True, 0), ("c", 5, " ", True, 0), ("d", 6, "cs.LG", None, 0), ("e", 7, "zz", True, 0)]
    pool = spark.createDataFrame(rows, schema)
    shares = spark.createDataFrame([("cs.LG", 1, 500, 1), ("cs.LG", 0, 500, 2), (None, 1, 0, 0)], "category string, numeric_flag int, share_pm int, min_rows int")
    got = {r["numeric_flag"]: (r["papers"], r["wanted"], r["short"]) for r in calibrate.report(spark, pool, shares).collect()}
    assert got == {1: (1, 1, False), 0: (1, 2, True)}
    empty = calibrate.report(spark, pool.limit(0), shares)
    assert [r["short"] for r in empty.collect()] == [True, True] and calibrate.sampled(pool.limit(0), empty).count() == 0
    assert calibrate.report(spark, pool, shares.limit(0)).count() == 0


# p5


def test_p5_chunks_move_with_their_words():
    a = words("We mask labels in seven museums and count the errors of each run with care before the second teacher arrives at dawn")
    inside = {d for d, _ in overlap.chunks(a)}
    moved = {d for d, _ in overlap.chunks(words("Nothing else was said about that") + a)}
    assert len(inside & moved) >= len(inside) - 1 and sum(n for _, n in overlap.chunks(a)) == len(a)


def test_p5_recall_against_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    e = overlap.evaluation_records(spark.read.parquet(f"{d}/holdout.parquet")).collect()
    t = overlap.training_records(spark.read.parquet(f"{d}/distilled.parquet")).collect()
    bags = [(r["rec_id"], Counter(r["words"].split()), r["n_words"]) for r in t]
    want = set()
    for r in e:
        own = Counter(r["words"].split())
        want |= {(min(r["rec_id"], k), max(r["rec_id"], k)) for k, bag, n in bags if sum((own & bag).values()) >= overlap.AGREE * max(n, r["n_words"])}
    got = [tuple(x) for x in overlap.p5_found(spark, d).collect()]
    assert len(got) == len(set(got)) and len(want) > 10 and len(want & set(got)) >= 0.9 * len(want) and set(got) <= want


def test_p5_edge_cases(spark):
    text = "we mask seven labels in nine museums and then count every error of the second run at dawn"
    say = lambda c, role="user": {"role": role, "content": c}
    h = [(1, [say("Title: x\nAbstract: " + text)]), (2, None), (3, []), (4, [None, say(None), say(" ")]), (5, [say("Ready?"), say("yes", "assistant"), say("ABSTRACT: <b>" + text.upper() + "</b>")]), (6, [say("short")])]
    holdout = spark.createDataFrame(h, "rec_id bigint, messages array<struct<role:string,content:string>>")
    distilled = spark.createDataFrame([(11, text, "a"), (12, text, "a"), (13, None, "a"), (14, "", "a"), (15, text[:20], "a")], "rec_id bigint, abstract string, words string")
    got = sorted((r["e_id"], r["t_id"]) for r in overlap.compared(holdout, distilled).collect())
    assert got == [(1, 11), (1, 12), (5, 11), (5, 12)]
    assert overlap.compared(holdout.limit(0), distilled).count() == 0 == overlap.compared(holdout, distilled.limit(0)).count()


