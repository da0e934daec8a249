"""p1: nested records as flat node tables linked by interval labels.

A depth-first traversal numbers every node of a record: `pre` as it is entered, `post` as it is left,
both from one counter. A node lies inside another exactly if its interval does. The type of a node is its
path without positions, so two nodes of one type never nest, and the node of type P that encloses a node
is the last P entered before it, if that one is left after it: link() finds it in one pass over a record.

Null values are no nodes but keep their position; a single value where a list belongs is element 0; text
that holds a JSON object or list counts as that; null, empty or unreadable records and records that are
not one object give no nodes. Nesting is unlimited as far as the JSON parser reads it (deeper texts count
as unreadable). Rows are kept whole: equal records under different keys give nodes for each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.base import spread, table

#: Fields that hold lists, even where one value stands alone.
LISTS = frozenset({"benchmarks", "results", "grounding_flags", "modalities", "method_keywords", "soft_flags", "seeds", "tries"})
NODES = "tab string, parent_key bigint, type string, name string, pos int, depth int, pre int, post int, value string"


def opened(value):
    """What a text holds if it is a JSON object or list, else the value itself."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            break
    return value


def record_of(text: str | None) -> dict | None:
    """The one JSON object that a text holds, also inside a JSON string; else None."""
    try:
        value = opened(json.loads(text)) if text else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def label(record: dict) -> list[list]:
    """[type, name, pos, depth, pre, post, value] of every node in order of entry, without recursion.

    pos is the place in a list, else None; value the scalar as JSON text, None for objects.
    """
    out: list[list] = []
    count = 0
    stack: list[tuple] = [(False, record, "$", "$", None, 0)]  # (leaving?, value or its node, type, name, pos, depth)
    while stack:
        leaving, value, kind, name, pos, depth = stack.pop()
        if leaving:
            value[5] = count
            count += 1
            continue
        node = [kind, name, pos, depth, count, None, None if isinstance(value, dict) else json.dumps(value, ensure_ascii=False)]
        count += 1
        out.append(node)
        stack.append((True, node, kind, name, pos, depth))
        if isinstance(value, dict):
            base = "" if kind == "$" else f"{kind}."
            for field, child in reversed(value.items()):
                if isinstance(child := opened(child), list) or field in LISTS:
                    elements = child if isinstance(child, list) else [] if child is None else [child]
                    flat = _flattened(elements)
                    stack += [(False, x, f"{base}{field}[]", field, i, depth + 1) for i, x in reversed(flat)]
                elif child is not None:
                    stack.append((False, child, f"{base}{field}", field, None, depth + 1))
    return out


def _flattened(elements: list) -> list[tuple[int, object]]:
    """(place, value) of the non-null elements; a list inside a list becomes an object with field `items`."""
    out = []
    for i, x in enumerate(elements):
        if isinstance(x := opened(x), list):
            x = {"items": x}
        if x is not None:
            out.append((i, x))
    return out


def nodes(df: DataFrame, tab: str, key: str, text: str | Column) -> DataFrame:
    """The nodes of the records in `text` (JSON), keyed by `key`; columns as in NODES, other columns are left behind."""
    got = spread(df.select(F.col(key).cast("bigint").alias("parent_key"), (F.col(text) if isinstance(text, str) else text).alias("text")), "parent_key")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"tab": pa.string(), "parent_key": pa.int64(), "type": pa.string(), "name": pa.string(), "pos": pa.int32(), "depth": pa.int32(), "pre": pa.int32(), "post": pa.int32(), "value": pa.string()}
        schema = pa.schema(list(types.items()))
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            for parent, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (record := record_of(payload)) is not None:
                    for node in label(record):
                        for column, x in zip(columns, (tab, parent, *node)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], schema=schema)

    return got.where("text IS NOT NULL").mapInArrow(walk, NODES)


def link(found: DataFrame, parents: str, *children: str) -> DataFrame:
    """Nodes of the types `parents` and `children`; column `parent` (pre, post, pos) is the enclosing one of type `parents`, null if none.

    One shuffle by record; the frame never holds more than one record.
    """
    own = Window.partitionBy("tab", "parent_key").orderBy("pre")
    at = F.last(F.when(F.col("type") == parents, F.struct("pre", "post", "pos")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return found.where(F.col("type").isin(parents, *children)).withColumn("parent", at).withColumn("parent", F.when(F.col("parent.post") > F.col("post"), F.col("parent")))


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.to_json(F.struct("extraction", "grounding_flags"), {"ignoreNullFields": "false"})
    d = nodes(table(spark, sf_dir, "distilled"), "distilled", "rec_id", typed)
    return d.unionByName(nodes(table(spark, sf_dir, "raw_records"), "raw_records", "raw_id", "payload"))


def node_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The flat table of one node type, e.g. extraction.benchmarks[]."""
    return all_nodes(spark, sf_dir).where(F.col("type") == kind)


BENCH, RESULT, FLAG = "extraction.benchmarks[]", "extraction.benchmarks[].results[]", "grounding_flags[]"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the nested lists with their place; a result's place holds that of the benchmark enclosing it."""
    got = link(all_nodes(spark, sf_dir), BENCH, RESULT, FLAG)
    path = (
        F.when(F.col("type") == BENCH, F.format_string("benchmarks[%d]", "pos"))
        .when(F.col("type") == FLAG, F.format_string("grounding_flags[%d]", "pos"))
        .when(F.col("parent").isNotNull(), F.format_string("benchmarks[%d].results[%d]", "parent.pos", "pos"))
    )
    return got.select("tab", "parent_key", path.alias("path")).where("path IS NOT NULL")


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of all records: the node tables of every type in one."""
    return all_nodes(spark, sf_dir)


def p1_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, records and greatest depth of each node table."""
    return all_nodes(spark, sf_dir).groupBy("tab", "type").agg(F.count("*").alias("n_nodes"), F.countDistinct("parent_key").alias("n_records"), F.max("depth").alias("depth"))
