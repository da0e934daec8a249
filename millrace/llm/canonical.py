"""p6: freely typed names and metrics mapped to a reference list.

The reference entries and their aliases are paths of one trie per kind, searched with a Levenshtein automaton
(millrace.functions.lexicon); the radius grows with the length of the value, digits must agree, and of all
entries within it the nearest counts. Values that name none, or two equally near ones, come out as 0.
Null and blank values have no row; values equal to a canonical need none. Repeated rows come out each.
The list is fixed and goes to the workers with the function; equal values of a task are resolved once: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import spread, table
from millrace.functions.lexicon import Resolver
from millrace.operators.units import reference

FIELDS = ("name", "metric")
REF = ["ref_id", "kind", "canonical", "aliases"]


def blank(text: str) -> bool:
    return not any(c.isprintable() and not c.isspace() for c in text)


def mapped(triples: DataFrame, entries: list[dict]) -> DataFrame:
    """(ref_id, triple_id, field, value) for each non-blank value that is not a canonical of its kind."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {kind: Resolver([r for r in entries if r["kind"] == kind]) for kind in FIELDS}
        same = {kind: {r["canonical"] for r in entries if r["kind"] == kind} for kind in FIELDS}
        for batch in batches:
            keys = batch.column("triple_id").to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for kind in FIELDS:
                for k, value in zip(keys, batch.column(kind).to_pylist()):
                    if value is not None and value not in same[kind] and not blank(value):
                        for column, x in zip(out, (of[kind].find(value), k, kind, value)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["ref_id", "triple_id", "field", "value"])

    return spread(triples.select("triple_id", *FIELDS), "triple_id").mapInArrow(walk, "ref_id bigint, triple_id bigint, field string, value string")


def p6_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(table(spark, sf_dir, "bench_triples"), reference(spark, sf_dir, "ref_items", REF))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_mapped(spark, sf_dir).select("ref_id", "triple_id", "field")


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry and how often each occurs."""
    return p6_mapped(spark, sf_dir).where("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n"))
