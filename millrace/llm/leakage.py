"""p9: passages of evaluation items inside a corpus.

The passages of the items are indexed once: an inverted index with BM25 impacts, and the largest impact of each term
in each block of passages. Every window of every document is a query against it; block-max WAND returns all passages
whose score reaches their own bar. The bar is derived, not tuned: the least score that a stretch of RUN words, or
NEAR of the sentence, can have, so no case can stay below it. What comes back is verified word by word:
a run of RUN words, or a sentence NEAR of whose words stand in order within a stretch of the passage.
An opening line that several items share is not indexed.

Null, empty and blank documents and items have no rows; repeated documents come out each; an item counts once per
document. Items are a fixed set; if there are more than BLOCK of them, they are taken in blocks, each against
all documents. The index goes to the workers with the function: no shuffle but to spread small scans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import spread, table
from millrace.functions.words import words

#: Words in a row that make a case, share of a sentence's words that must stand in order, words of the shortest sentence.
RUN, NEAR, LEAST = 11, 0.75, 5
#: BM25 constants, passages per block of the index, items per index.
K1, B, PER_BLOCK, BLOCK = 1.2, 0.75, 4, 20_000
END = 1 << 60


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if x]


def opening(text: str | None) -> str | None:
    """The first of several sentences, which may be an instruction."""
    return s[0] if len(s := sentences(text or "")) > 1 else None


class Index:
    """Inverted index of item passages: sentences, and the joints between them that a run may cross.

    Impacts are divided by the bar of their passage, so that every bar is 1. Passages are numbered; blocks are
    ranges of PER_BLOCK numbers, the same for all terms, and `tops` has each term's largest impact in each.
    """

    def __init__(self, rows: list[tuple[int, str]], shared: set[str]):
        self.units: list[tuple[int, list[str], bool]] = []  # item, words, whether a sentence
        for item, text in sorted(rows):
            own = sentences(text)
            if len(own) > 1 and own[0] in shared:
                own = own[1:]
            parts = [w for s in own if (w := words(s))]
            self.units += [(item, p, True) for p in parts if len(p) >= LEAST]
            line, at = [w for p in parts for w in p], 0
            for p in parts:  # a run may also begin in one sentence and end in another
                at += len(p)
                if len(p) < LEAST or at < len(line):
                    joint = line[max(0, at - len(p) if len(p) < LEAST else at - RUN + 1) : at + RUN - 1]
                    if len(joint) >= RUN:
                        self.units.append((item, joint, False))
        counts = [Counter(w) for _, w, _ in self.units]
        mean = sum(sum(c.values()) for c in counts) / max(1, len(counts))
        df = Counter(w for c in counts for w in c)
        idf = {w: math.log(1 + (len(counts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.term = {w: i for i, w in enumerate(sorted(df))}
        self.longest = max([RUN, *(len(w) for _, w, _ in self.units)])
        self.runs: list[set[tuple]] = []
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.tops = np.zeros((len(self.term), -(-len(counts) // PER_BLOCK)))
        for k, ((_, line, whole), count) in enumerate(zip(self.units, counts)):
            size = K1 * (1 - B + B * len(line) / mean)
            impact = {w: idf[w] * n * (K1 + 1) / (n + size) for w, n in count.items()}
            runs = {tuple(line[i : i + RUN]) for i in range(len(line) - RUN + 1)}
            least = [sum(impact[w] for w in set(run)) for run in runs]
            if whole:  # as few words as make the sentence a case, the lightest ones, each counted once
                score, left = sum(impact.values()), len(line) - math.ceil(NEAR * len(line))
                for x, n in sorted(((impact[w], n) for w, n in count.items()), reverse=True):
                    if n <= left:
                        score, left = score - x, left - n
                least.append(score)
            bar = max(min(least) * (1 - 1e-6), 1e-9)
            self.runs.append(runs)
            for w, x in impact.items():
                t = self.term[w]
                postings[t].append((k, x / bar))
                self.tops[t, k // PER_BLOCK] = max(self.tops[t, k // PER_BLOCK], x / bar)
        self.ids = [[k for k, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]

    def above(self, terms: list[int]) -> list[int]:
        """Numbers of all passages whose score for the terms reaches their bar: block-max WAND with the fixed threshold 1."""
        tops = self.tops[terms]
        out: list[int] = []
        for block in np.nonzero(tops.sum(axis=0) >= 1)[0].tolist():  # in the others nothing can
            out += self.pivots(terms, tops[:, block].tolist(), block)
        return out

    def pivots(self, terms: list[int], most: list[float], block: int) -> list[int]:
        """WAND within one block: only passages where the largest impacts of the terms at hand can reach the bar are scored."""
        first, end, out = block * PER_BLOCK, (block + 1) * PER_BLOCK, []
        cursors = []
        for t, top in zip(terms, most):
            if top > 0:
                i = bisect_left(ids := self.ids[t], first)
                cursors.append([ids[i], i, t, top])
        while True:
            cursors.sort()
            bound, pivot = 0.0, END
            for k, _, _, top in cursors:
                bound += top
                if bound >= 1:
                    pivot = k
                    break
            if pivot >= end:
                return out
            if cursors[0][0] == pivot:
                score, target = sum(self.impacts[t][i] for k, i, t, _ in cursors if k == pivot), pivot + 1
                if score >= 1:
                    out.append(pivot)
            else:
                target = pivot
            for c in cursors:
                if c[0] >= target:
                    break
                ids = self.ids[c[2]]
                c[1] = bisect_left(ids, target, c[1])
                c[0] = ids[c[1]] if c[1] < len(ids) and ids[c[1]] < end else END

    def held(self, text: str | None) -> list[int]:
        """The items in the text as it stands, or with the words joined that a line's end divides."""
        joined = re.sub(r"(?<=[^\W\d_])[-‐]\s*[\r\n]+\s*(?=[^\W\d_])", "", text or "")
        return sorted(self.within(words(text)) | (self.within(words(joined)) if joined != text else set()))

    def within(self, line: list[str]) -> set[int]:
        """Ids of the items that the words hold; windows overlap by half, so none is cut by their edges."""
        half = self.longest + self.longest // 3 + 3
        found: set[int] = set()
        places = [(i, t) for i, w in enumerate(line) if (t := self.term.get(w)) is not None]
        at = [i for i, _ in places]
        for start in range(0, max(1, len(line) - half), half):
            terms = {t for _, t in places[bisect_left(at, start) : bisect_left(at, start + 2 * half)]}
            if len(terms) < LEAST - 1:
                continue
            for k in self.above(sorted(terms)):
                item, s, whole = self.units[k]
                if item not in found and verified(line[start : start + 2 * half], s, whole, self.runs[k]):
                    found.add(item)
        return found


def verified(passage: list[str], s: list[str], whole: bool, runs: set[tuple]) -> bool:
    """Whether the passage holds a run of it, or NEAR of the sentence in order within a stretch of about its length."""
    if any(tuple(passage[i : i + RUN]) in runs for i in range(len(passage) - RUN + 1)):
        return True
    return whole and sum((Counter(s) & Counter(passage)).values()) >= NEAR * len(s) and ordered(s, passage) >= NEAR * len(s)


def ordered(s: list[str], passage: list[str]) -> int:
    """Most words of `s` that stand in order within any stretch of the passage of its length and a quarter."""
    span, at, best = len(s) + max(3, len(s) // 4), set(s), 0
    starts = [i for i, w in enumerate(passage) if w in at]
    for i, p in enumerate(starts):
        inside = bisect_left(starts, p + span) - i
        if inside > best:
            best = max(best, common([w for w in passage[p : p + span] if w in at], s))
    return best


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def leaked(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id) of each item in each document."""
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = own.count()
    first = F.udf(opening, "string", useArrow=True)
    shared = {r["line"] for r in own.select(first("text").alias("line")).where("line IS NOT NULL").groupBy("line").count().where("count > 1").select("line").collect()}
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").where("text IS NOT NULL")
    parts, count = [], max(1, -(-n // block))
    for b in range(count):
        index = Index([tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b).collect()], shared)

        def walk(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, k) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in index.held(text)]
                columns = list(zip(*rows)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id"])

        parts.append(docs.mapInArrow(walk, "item_id bigint, doc_id bigint"))
    return reduce(DataFrame.unionAll, parts)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that leaked and the number of documents that hold each."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
