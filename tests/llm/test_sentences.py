"""p10 against labelled cases, an exhaustive search of the chain, and edge cases."""

import itertools
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
from millrace.llm import sentences  # noqa: E402


@pytest.fixture(scope="module")
def weights(spark):
    return sentences.model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 900)


CASES = [
    ("See Fig. 2 of Dr. A. Be. It failed! ", [24, 35]), ('He wrote, "Why not? It is easy." and left. So what?', [42, 51]), ("## 1. Setup\n- one\n- two", [11, 17, 23]), ("标签太慢。它“好。”然后结束。", [5, 15]), ("กข คง", [2, 5]), (" \n", []),
    ("It costs 3.5 GB per run. Then it stops.", [24, 39]), ("Labels are kept.The run ends.", [16, 29]), ("Set it in train.cfg and go. See https://a.b/C.d for more.", [27, 57]), ("User: (It was run twice.) Then it failed.", [25, 41]),
    ("Im 2. Schritt fällt der Wert. Am 3. Mai war Schluss.", [29, 52]), ("Selon M. Drummel, le modèle suffit. « Oui. » dit-il.", [35, 52]), ("По словам д-ра А. Б. Кверина, он прав. См. рис. 3.", [38, 50]), ("यह धीमा है। फिर भी ठीक है।", [11, 26]), ("A line\nwraps here. Next.", [18, 24]),
]


@pytest.mark.parametrize("text, ends", CASES)
def test_cases(weights, text, ends):
    assert sentences.ends(text, weights.tolist()) == ends


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        own, both = [rng.uniform(-2, 2) for _ in range(n)], [rng.uniform(-2, 2) for _ in range(n)]
        value = lambda tags: sum(o for o, t in zip(own, tags) if t) + sum(both[k] for k in range(1, n) if tags[k] and tags[k - 1])  # noqa: E731, B023
        best = max(itertools.product((False, True), repeat=n), key=value)
        assert abs(value(sentences.viterbi(own, both)) - value(best)) < 1e-9


def test_tags_agree_with_held_out_labels(spark, weights):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    w, right, count = weights.tolist(), 0, 0
    for text in texts:
        got = set(sentences.ends(text, w))
        for begin, end, found in sentences.chains(text):
            for p in found:
                count += 1
                right += (p.end in got) == (p.thai or sentences.silver(text, begin, end, p))
    assert count > 300 and right >= 0.98 * count


def test_edge_cases(spark, weights):
    rows = [(1, None, 0), (2, "", 0), (3, " ​\n", 0), (4, "One. Two.", 0), (4, "One. Two.", 0), (5, "Word and word. " * 5000, 0), (6, "(" * 3000 + "。" * 3000, 0), (7, "éte. Fin.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sent_end int")
    got = sorted(map(tuple, sentences.split(df, weights).collect()))
    assert [g for g in got if g[0] < 5] == [(4, 4), (4, 4), (4, 9), (4, 9)] and sum(g[0] == 5 for g in got) == 5000 and [g for g in got if g[0] == 7] == [(7, 5), (7, 10)]
    assert sentences.split(df.limit(0), weights).count() == 0 and (sentences.model(df.limit(0)) == 0).all()
