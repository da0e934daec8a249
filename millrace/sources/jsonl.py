"""JSON lines and text lists: strict, tolerant and keyed scans, and sinks that never write what is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As strict(), but malformed lines come out with the line in _corrupt_record and the fields null."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def keyed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The last row of each key by place in the file; keys as text."""
    rows = tolerant(spark, path, schema).withColumn("_at", F.monotonically_increasing_id()).where(F.col(CORRUPT).isNull())
    rest = [c for c in rows.columns if c not in (key, CORRUPT, "_at")]
    last = rows.groupBy(F.col(key).cast("string").alias(key)).agg(F.max_by(F.struct(*rest), "_at").alias("r"))
    return last.select(key, "r.*")


def counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(lines, readable): lines that are not blank, and those that parse."""
    lines = spark.read.text(path).where(F.col("value").rlike("\\S"))
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})[CORRUPT].isNull()).alias("readable"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(id): the words of a text file, none if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), "\\s+")).alias("id")).where("id <> ''").distinct()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Write beside `path`, then put the result in its place; df may read from `path`."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    fs = at.getFileSystem(conf)
    df.write.mode("overwrite").json(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, at):
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def routed(df: DataFrame, accepted, ok_path: str, rejected_path: str) -> None:
    """Append rows where the condition `accepted` holds to one sink and all others, nulls included, to another; df is computed once."""
    df = df.persist()
    try:
        append(df.where(accepted), ok_path)
        append(df.where(~F.coalesce(accepted, F.lit(False))), rejected_path)
    finally:
        df.unpersist()


def report(df: DataFrame, path: str) -> None:
    """One row as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def losses(spark: SparkSession, path: str, steps_per_epoch: float = 1081.0) -> DataFrame:
    """(step, loss) of the lines of a training log that hold both 'loss' and 'epoch'."""
    value = lambda k: F.regexp_extract("value", f"'{k}': '?([0-9.eE+-]+)", 1).try_cast("double")
    got = spark.read.text(path).select(value("loss").alias("loss"), value("epoch").alias("epoch")).where("loss IS NOT NULL AND epoch IS NOT NULL")
    return got.select((F.col("epoch") * steps_per_epoch).alias("step"), "loss")
