"""p8: the whole corpus as token ids of a public byte-level BPE.

A text is split by the tokenizer's pattern; each piece starts as single bytes in a doubly linked list, and a
priority queue of merge ranks joins neighbours until no pair of the vocabulary is left, entries whose
symbols have changed meanwhile being skipped. Null and empty texts give []; nothing is normalised and
special-token strings are ordinary text, so decoding by concatenation restores every text. Each row is
encoded whole and on its own: no shuffle but to spread small scans.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.base import spread, table

#: Pieces remembered per task, and the longest piece remembered.
KEPT, LONGEST = 200_000, 64


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """Ranks of the tokenizer file at `path` (default: the installed byte_bpe_50k)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: lowest rank first, leftmost first among equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the symbol that starts at i, which lives while end[i] > 0
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, stop = heappop(queue)
        middle = end[i]
        if middle == 0 or middle >= stop or end[middle] != stop:
            continue  # stale: a symbol of the pair has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(queue, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heappush(queue, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts, remembering a bounded number of short pieces."""

    def __init__(self, path: str | None = None):
        self.ranks, self.split, self.seen = vocabulary(path), pattern(), {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for piece in self.split.findall(text or ""):
            if (ids := seen.get(piece)) is None:
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= LONGEST:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        strings = {i: b for b, i in self.ranks.items()}
        return b"".join(strings[i] for i in ids).decode("utf-8")


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) for each row; other columns are left behind."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):  # ids of few texts at a time stand as Python numbers
                part = batch.slice(at, 500)
                ids = pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return spread(df.select(df[key].cast("bigint").alias("doc_id"), df[text].alias("text")), "doc_id").mapInArrow(walk, "doc_id bigint, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text")
