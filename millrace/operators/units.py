"""p4: reported values in the common unit of their metric.

Metrics are resolved with the trie of millrace.functions.lexicon; unit strings are segmented by dynamic
programming (millrace.functions.unitparse). Null metrics, null and empty values, placeholders, unknown
metrics and metrics without a common unit give no converted value; repeated rows are converted each;
infinite and NaN values count as absent. All rows of a batch with the same text are resolved once, the
reference tables (fixed, checked by bounded()) go to the workers with the function: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import bounded, table
from millrace.functions.lexicon import Resolver
from millrace.functions.unitparse import convert, unit_of_source

COLUMNS = ["triple_id", "source", "metric", "value_num", "value_str"]
CONVERTED = "triple_id bigint, metric_ref bigint, unit string, value_common double, restated boolean"


def reference(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> list[dict]:
    """A fixed reference table as rows; an error if it is not small after all."""
    rows = bounded(table(spark, sf_dir, name).select(*columns))
    if rows is None:
        raise ValueError(f"{name} is meant to be a small reference table")
    return [r.asDict() for r in rows]


def converted(triples: DataFrame, metrics: list[dict], units: list[dict]) -> DataFrame:
    """Columns of CONVERTED for each row with a usable value; needs COLUMNS, others are left behind."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver, of = Resolver(metrics), {r["ref_id"]: (r["family"], r["common_unit"]) for r in metrics}
        by_source = {(r["source"], r["family"]): unit_of_source(r["family"], r["unit"], r["note"]) for r in units}
        seen: dict[tuple, tuple | None] = {}
        for batch in batches:
            keys, *rest = (batch.column(c).to_pylist() for c in COLUMNS)
            out: list[tuple] = []
            for key, source, metric, value_num, value_str in zip(keys, *rest):
                if metric is None or value_num is None and value_str is None:
                    continue
                ref = resolver.find(metric)
                family, common = of.get(ref, (None, None))
                if not common:
                    continue
                # A number is one factor away; only texts are worth remembering.
                case = (ref, metric, value_str, by_source.get((source, family))) if value_str is not None else None
                if case is None or (got := seen.get(case, False)) is False:
                    got = convert(family, common, metric, value_num, value_str, by_source.get((source, family)))
                    if case is not None and len(seen) < 100_000:
                        seen[case] = got
                if got is not None:
                    out.append((key, ref, common, *got))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["triple_id", "metric_ref", "unit", "value_common", "restated"])

    return triples.select(*COLUMNS).where("metric IS NOT NULL AND (value_num IS NOT NULL OR value_str IS NOT NULL)").mapInArrow(walk, CONVERTED)


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable value in the common unit of its metric."""
    metrics = [r for r in reference(spark, sf_dir, "ref_items", ["ref_id", "kind", "canonical", "aliases", "family", "common_unit"]) if r["kind"] == "metric"]
    units = reference(spark, sf_dir, "source_units", ["source", "family", "unit", "note"])
    return converted(table(spark, sf_dir, "bench_triples"), metrics, units)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples whose value was stated in another unit or scale than the common one."""
    return p4_values(spark, sf_dir).where("restated").select("triple_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable and restated values by source; sources are pre-aggregated before the shuffle."""
    got = p4_values(spark, sf_dir).join(table(spark, sf_dir, "bench_triples").select("triple_id", "source"), "triple_id")
    return got.groupBy("source").agg(F.count("*").alias("n_usable"), F.count_if("restated").alias("n_restated"))
