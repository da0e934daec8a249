"""p2, p3 and p9 against made cases, exhaustive search and edge cases."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
from millrace.functions.words import words  # noqa: E402
from millrace.llm import leakage, markup, truncation  # noqa: E402

# p2


def texts(spark, small):
    return [(r["source"], r["text"], r["id"]) for r in truncation.unified(spark, "/root/testdata/sf0.01").where("text IS NOT NULL").collect()]


@pytest.fixture(scope="module")
def weights(spark, small):
    return truncation.fitted(truncation.examples(texts(spark, small)))


def test_p2_held_out_cuts_are_told_from_whole_texts(spark, small):
    rows = texts(spark, small)
    random.Random(3).shuffle(rows)
    half = len(rows) // 2
    weights = truncation.fitted(truncation.examples(rows[:half]))
    held = truncation.examples(rows[half:], seed=9)
    right = sum((weights[truncation.features(t, limit)].sum() > 0) == cut for t, limit, cut in held)
    assert len(held) > 500 and right >= 0.95 * len(held)


@pytest.mark.parametrize("text, cut", [
    ('{"task_type": "other", "method_keywords": ["b', True), ('{"task_type": "other", "limitation_mentioned": null} No limitation is state', True), ("The paper is about code completion and it masks labels of the set and ne", True),
    ('{"task_type": "other", "limitation_mentioned": null}', False), ("The paper is about code completion and it masks labels. No limitation is stated.", False), ("```json\n{\"a\": 1}\n", True), ("null", False), ("[]", False),
])
def test_p2_cases(weights, text, cut):
    assert bool(weights[truncation.features(text, False)].sum() > 0) is cut


def test_p2_edge_cases(spark):
    rows = [("pred", 1, "a", "s", None), ("pred", 2, "a", None, ""), ("pred", 3, None, "s", " \n"), ("pred", 4, "a", "s", "x" * 20000), ("pred", 4, "a", "s", "x" * 20000), ("rejected", 5, "b", "s", '{"a": [1, 2')]
    df = spark.createDataFrame(rows, "tab string, rec_key bigint, id string, source string, text string")
    got = [(r["rec_key"], r["score"]) for r in truncation.scored(df, truncation.model(df)).collect()]
    assert sorted(k for k, _ in got) == [1, 2, 3, 4, 4, 5] and all(s == 0 for k, s in got if k < 4) and all(s > 0.5 for k, s in got if k == 5)
    assert truncation.scored(df.limit(0), truncation.model(df.limit(0))).count() == 0


# p3


@pytest.mark.parametrize("text, clean", [
    ("<jats:p>We <i>use</i> R &amp; D</jats:p>", "We use R & D"), ("## Setup\nthe **best** `x = 1`", "## Setup\n\nthe best `x = 1`"), ("<ul><li>one</li><li>two</li></ul>", "- one\n- two"),
    ("a\n\n```python\nrun(1)\n```\n", "a\n\n```\nrun(1)\n```"), ("in $O(n \\log n)$ time\\cite{abc25}.", "in $O(n \\log n)$ time."), ("\\begin{itemize} \\item one \\item two \\end{itemize}", "- one\n- two"), ("== Data ==\n[[page|link]] {{note|x}}", "## Data\n\nlink"),
    ("Schr\\\"{o}del and 5\\% of {\\it all}", "Schrödel and 5% of all"), ("<math>\\alpha_{t-1}</math>", "$\\alpha_{t-1}$"), ("\\section{Intro} text", "# Intro\n\ntext"), ("<b>never closed", "never closed"), ("<!-- x -->a", "a"),
])
def test_p3_clean_text_keeps_structure(text, clean):
    root = markup.tree(text)
    assert markup.elements(root) > 0 and markup.tidy(markup.plain(root)) == clean


@pytest.mark.parametrize("text", ["R&D for C# and A* at p < 0.05 and $5 to $10, max_len 3", "x > y & z, <22 ms, a grid of 5 * 3 {0, 1} [30] -- ~19% #3", "", "plain"])
def test_p3_plain_signs_are_text(text):
    root = markup.tree(text)
    assert markup.elements(root) == 0 and markup.plain(root) == text


def test_p3_templates_are_deleted_and_edge_cases(spark):
    rows = [(i, f"<p>Text number {i} <a href='/x'>subscribe to our weekly letter</a></p>", "h", None) for i in range(20)] + [(99, None, "h", ""), (98, "a <b>bold</b> word", None, "t"), (98, "a <b>bold</b> word", None, "t"), (97, "&lt;" * 3000, "h", "t")]
    df = spark.createDataFrame(rows, "rec_id bigint, abstract string, host string, clean string")
    got = markup.cleaned(df, "rec_id", "host", "abstract").collect()
    assert len(got) == 23 and {r["clean"] for r in got if r["rec_id"] < 20} == {f"Text number {i}" for i in range(20)}
    assert [r["clean"] for r in got if r["rec_id"] == 98] == ["a bold word"] * 2 and next(r["clean"] for r in got if r["rec_id"] == 97) == "<" * 3000
    assert markup.cleaned(df.limit(0), "rec_id", "host", "abstract").count() == 0


def test_p3_deep_and_unbalanced_markup():
    assert markup.elements(markup.tree("<div>" * 300 + "x" + "</p>" * 20)) == 320
    assert markup.tidy(markup.plain(markup.tree("**" * 500 + "[[" * 200)))


# p9

ITEMS = [(1, "Choose one. A tall weaver counts 12 red kites in the old mill before noon."), (2, "Choose one. Ten brass hooks break before the spring fair, so Bel owes us coins for each of them."), (3, "Alone."), (4, None)]


def frame(spark, docs):
    return leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(ITEMS, "item_id bigint, text string"))


def test_p9_cases(spark):
    docs = [
        (10, "Then a tall weaver just counts 12 red\nkites in the old mill before noon.", 0), (11, "Choose one. A tall weaver counts 12 blue hats, ten brass hooks break.", 0), (12, "x y so Bel owes us coins for each of them z", 0), (13, None, 0), (14, "", 0),
        (15, "hooks break before the spring fair, so Bel owes us coins", 0), (16, "word " * 30000 + "a tall weaver counts 12 red kites in the old mill before noon", 0), (10, "a tall weaver counts 12 red kites in the old mill before noon", 0),
    ]
    assert sorted(map(tuple, frame(spark, docs).collect())) == [(1, 10), (1, 10), (1, 16), (2, 15)]
    assert frame(spark, docs[:1]).where("doc_id = 0").count() == 0
    empty = leakage.leaked(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string"))
    assert empty.count() == 0


def test_p9_wand_finds_all_that_exhaustive_search_finds(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "text").collect() if r["text"]]
    openings = Counter(leakage.opening(t) for _, t in items)
    index = leakage.Index(items, {k for k, n in openings.items() if k and n > 1})
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    half, found = index.longest + index.longest // 3 + 3, 0
    for text in docs[::4]:
        line, want = words(text), set()
        for start in range(0, max(1, len(line) - half), half):
            passage = line[start : start + 2 * half]
            want |= {item for (item, s, whole), runs in zip(index.units, index.runs) if leakage.verified(passage, s, whole, runs)}
        assert index.within(line) == want
        found += len(want)
    assert found > 3


def test_p9_blocks_of_items_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet")
    whole = sorted(map(tuple, leakage.leaked(docs, items).collect()))
    assert whole == sorted(map(tuple, leakage.leaked(docs, items, block=100).collect())) and whole
