"""p5: where its pairs are made."""

import random
import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parents[2]))
from millrace.llm import overlap  # noqa: E402


def test_p5_texts_that_share_boilerplate_make_no_pairs_to_compare(spark, monkeypatch):
    shared = "code and data of this work will be made public after the review and we thank all members of the two groups"
    text = lambda side, i: " ".join([shared, *(f"{side}{i}x{j}" for j in range(20))])
    n, search, pairs = 500, overlap.overlapping, []
    e = [(i, [{"role": "user", "content": "Abstract: " + text("e", i)}]) for i in range(n)]
    t = [(n + i, text("t", i)) for i in range(n)] + [(2 * n, text("e", 7).upper()), (2 * n + 1, text("e", 7))]
    monkeypatch.setattr(overlap, "overlapping", lambda *a: pairs.append(search(*a)) or pairs[0])
    got = overlap.compared(spark.createDataFrame(e, "rec_id bigint, messages array<struct<role:string,content:string>>"), spark.createDataFrame(t, "rec_id bigint, abstract string"))
    assert sorted((r["e_id"], r["t_id"]) for r in got.collect()) == [(7, 2 * n), (7, 2 * n + 1)]
    assert pairs[0].count() < n


def test_p5_blocks_find_what_one_index_finds(monkeypatch):
    rng = random.Random(3)
    texts = [rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(8, 14)) for _ in range(120)]
    texts += [t[:-1] + ["new"] for t in texts[:40]]

    def batch(side, rows):
        data = {"training": [side] * len(rows), "e": None if side else list(rows), "text_id": [b"%d" % i for i in rows], "n_words": [len(texts[i]) for i in rows]}
        data |= {"digests": [[hash(w) for w in set(texts[i])] for i in rows], "sketch": [overlap.sketch(texts[i]) for i in rows]}
        types = [pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v if v is not None else [None] * len(rows), t) for v, t in zip(data.values(), types)], names=list(data))

    batches = [batch(False, range(i, i + 10)) for i in range(0, 80, 10)] + [batch(True, range(i, i + 16)) for i in range(80, 160, 16)]
    pairs = lambda: sorted((r["e"], int(r["t"])) for b in overlap.met(iter(batches)) for r in b.to_pylist())
    one = pairs()
    agreeing = {(i, j) for i in range(80) for j in range(80, 160) if overlap.agree(" ".join(texts[i]), " ".join(texts[j])) >= overlap.AGREE}
    monkeypatch.setattr(overlap, "BLOCK", 20)
    monkeypatch.setattr(overlap, "AT_ONCE", 50)
    assert len(agreeing) >= 40 and agreeing <= set(one) and len(one) == len(set(one)) and pairs() == one


def test_p5_short_texts_are_read_too(spark):
    texts = ["Withdrawn.", "see the journal version", "we count seven masks in nine runs", "研究方法。结果很好。", "we count <b>seven</b> masks in two long runs"]
    blank = [None, "", "  ", "--- !", "<b></b>"]
    t = [(i, x) for i, x in enumerate(texts + blank)] + [(50, "withdrawn")]
    e = [(100 + i, None if x is None else [{"role": "user", "content": "Title: a\nAbstract: " + x}]) for i, x in enumerate(texts[:4] + blank)]
    got = overlap.compared(spark.createDataFrame(e, "rec_id bigint, messages array<struct<role:string,content:string>>"), spark.createDataFrame(t, "rec_id bigint, abstract string"))
    assert {(r["e_id"], r["t_id"]) for r in got.collect()} >= {(100, 0), (100, 50), (101, 1), (102, 2), (103, 3)}
    assert all(r["e_id"] < 104 and r["agreement"] >= overlap.AGREE for r in got.collect())
