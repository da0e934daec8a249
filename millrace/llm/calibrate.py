"""p7: a sample that follows target shares by category and numeric flag.

The latest row of each id counts (aggregated map-side, so an id with many rows is no hot key). The moments of the
categories are one grouped count; the dual of the exponential tilting is solved by Newton's method on these, and
the resulting probabilities drive the pivotal method: within each partition units meet in the order of a
hash, and what is still open at its end (at most one unit per stratum) meets again. Floors are fixed first, strata
that cannot reach theirs are taken whole and reported. Null ids count as one id; null flags, null or blank
categories and categories without a target are left out; an empty pool gives no sample and reports every stratum.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import bounded, checkpointed, table

#: One part of the pool in this many is drawn.
PART = 4
REPORT = "category string, numeric_flag int, share_pm int, min_rows int, papers bigint, wanted bigint, aim double, probability double, short boolean"


def latest(pool: DataFrame) -> DataFrame:
    """(id, cat, numeric_flag) of the latest row of each id, where usable."""
    got = pool.groupBy("id").agg(F.max_by(F.struct("categories", "numeric_signal"), "ingest_seq").alias("last"))
    cat = F.lower(F.regexp_extract("last.categories", "[^ \\t\\r\\n,;]+", 0))
    return got.select("id", cat.alias("cat"), F.col("last.numeric_signal").cast("int").alias("numeric_flag")).where("numeric_flag IS NOT NULL AND cat <> ''")


def aims(papers: np.ndarray, shares: np.ndarray, floors: np.ndarray, n: int) -> np.ndarray:
    """Rows to draw of each stratum: floors and exhausted strata fixed, the rest in proportion to the shares."""
    low, aim = np.minimum(floors, papers).astype(float), np.zeros(len(papers))
    fixed = np.zeros(len(papers), bool)
    for _ in range(len(papers) + 1):
        rest = max(0.0, n - aim[fixed].sum())
        weight = np.where(fixed, 0, shares).sum()
        free = rest * shares / weight if weight else np.zeros(len(papers))
        over, under = ~fixed & (free > papers), ~fixed & (free < low)
        if not (over | under).any():
            break
        aim[over], aim[under] = papers[over], low[under]
        fixed |= over | under
    return np.where(fixed, aim, free)


def tilt(papers: np.ndarray, aim: np.ndarray, n: int, x: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """Inclusion probabilities d * exp(x @ dual), capped at 1, with moments x.T @ (papers * p) = x.T @ aim.

    Newton's method on the dual, with halved steps while the capped moments get worse. x defaults to one
    indicator per stratum; margins of several categories are rows of indicators alike.
    """
    x = np.eye(len(papers)) if x is None else x
    d, dual, goal = n / max(papers.sum(), 1), np.zeros(x.shape[1]), x.T @ aim
    prob = lambda u: np.minimum(1.0, d * np.exp(np.clip(x @ u, -60, 60)))
    gap = lambda u: x.T @ (papers * prob(u)) - goal
    for _ in range(rounds):
        p, g = prob(dual), gap(dual)
        if np.abs(g).max(initial=0) < 1e-9:
            break
        curve = x.T @ (x * (papers * np.where(p < 1, p, d * np.exp(np.clip(x @ dual, -60, 60))))[:, None])
        step = np.linalg.lstsq(curve + 1e-12 * np.eye(len(g)), g, rcond=None)[0]
        scale = 1.0
        while scale > 1e-6 and np.abs(gap(dual - scale * step)).sum() > np.abs(g).sum():
            scale /= 2
        dual -= np.clip(scale * step, -5, 5)
    return prob(dual)


def report(spark: SparkSession, pool: DataFrame, shares: DataFrame) -> DataFrame:
    """A row for each target: papers there, rows wanted, rows aimed at, probability, and whether it falls short."""
    rows = bounded(shares.select("category", "numeric_flag", "share_pm", "min_rows"))
    if rows is None:
        raise ValueError("target_shares is meant to be a small reference table")
    rows = [r for r in rows if r["category"] is not None and r["numeric_flag"] is not None]
    cats = sorted({r["category"].lower() for r in rows})
    counted = {(r["cat"], r["numeric_flag"]): r["papers"] for r in latest(pool).where(F.col("cat").isin(cats)).groupBy("cat", "numeric_flag").agg(F.count("*").alias("papers")).collect()}
    n = sum(counted.values()) // PART
    papers = np.array([counted.get((r["category"].lower(), r["numeric_flag"]), 0) for r in rows], dtype=float)
    wanted = [max(r["min_rows"] or 0, (n * (r["share_pm"] or 0) + 500) // 1000) for r in rows]
    aim = aims(papers, np.array([r["share_pm"] or 0 for r in rows], dtype=float), np.array([r["min_rows"] or 0 for r in rows], dtype=float), n)
    p = tilt(papers, aim, n) if rows else []
    out = [(r["category"], r["numeric_flag"], r["share_pm"], r["min_rows"], int(k), int(w), float(a), float(q), bool(k < w)) for r, k, w, a, q in zip(rows, papers, wanted, aim, p)]
    return spark.createDataFrame(out, REPORT)


def uniform(*parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / 2.0**56


def pivotal(units: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """(units drawn, the unit still open) of (id, ..., probability) that meet one after another."""
    drawn, held = [], None
    for unit in units:
        if held is None:
            held = unit
        else:
            a, b = held[-1], unit[-1]
            u = uniform(seed, held[0], unit[0])
            if a + b <= 1:
                held = (*(held if a + b == 0 or u < a / (a + b) else unit)[:-1], a + b)
            else:
                first = (1 - b) / (2 - a - b) if a + b < 2 else 0.5
                goes, stays = (held, unit) if u < first else (unit, held)
                drawn.append(goes)
                held = (*stays[:-1], a + b - 1)
        if held[-1] > 1 - 1e-9:
            drawn.append(held)
            held = None
    return drawn, held


UNITS = "id string, cat string, numeric_flag int, probability double, settled boolean"


def sampled(pool: DataFrame, gaps: DataFrame, seed: int = 17) -> DataFrame:
    """(id, category, numeric_flag) of the papers drawn with the probabilities of `gaps`."""
    probability = {(r["category"].lower(), r["numeric_flag"]): (r["probability"], r["category"]) for r in gaps.collect()}
    if not probability:
        return pool.sparkSession.createDataFrame([], "id string, category string, numeric_flag int")
    known = pool.sparkSession.createDataFrame([(*k, p, c) for k, (p, c) in probability.items()], "cat string, numeric_flag int, probability double, category string")
    units = latest(pool).join(F.broadcast(known), ["cat", "numeric_flag"])
    ordered = units.select("id", "cat", "numeric_flag", "probability").sortWithinPartitions(F.xxhash64("id", F.lit(seed)))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for unit in batch.itertuples(index=False, name=None):
                key = unit[1:3]
                drawn, left = pivotal([*([held.pop(key)] if key in held else []), unit], seed)
                out += [(*x, True) for x in drawn]
                if left is not None:
                    held[key] = left
            yield pd.DataFrame(out, columns=["id", "cat", "numeric_flag", "probability", "settled"])
        yield pd.DataFrame([(*x, False) for x in held.values()], columns=["id", "cat", "numeric_flag", "probability", "settled"])

    def last(left: pd.DataFrame) -> pd.DataFrame:
        drawn, held = pivotal(list(left.sort_values("id")[["id", "cat", "numeric_flag", "probability"]].itertuples(index=False, name=None)), seed + 1)
        if held is not None and uniform(seed + 2, held[0]) < held[-1]:
            drawn.append(held)
        return pd.DataFrame([(*x, True) for x in drawn], columns=["id", "cat", "numeric_flag", "probability", "settled"])

    first = checkpointed(ordered.mapInPandas(meet, UNITS))
    # One open unit per partition and stratum at most: what meets here does not grow with the rows.
    second = first.where("NOT settled").groupBy("cat", "numeric_flag").applyInPandas(last, UNITS)
    drawn = first.where("settled").unionByName(second)
    return drawn.join(F.broadcast(known.select("cat", "numeric_flag", "category")), ["cat", "numeric_flag"]).select("id", "category", "numeric_flag")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "papers_pool"), table(spark, sf_dir, "target_shares"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata with fewer papers than wanted."""
    return p7_report(spark, sf_dir).where("short").select("category", "numeric_flag")


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "papers_pool"), p7_report(spark, sf_dir))


FOUND_SQL = r"""
WITH latest AS (
  SELECT categories, numeric_signal FROM (
    SELECT categories, numeric_signal, row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) AS rn FROM papers_pool
  ) AS ranked WHERE rn = 1 AND numeric_signal IS NOT NULL
), firsts AS (
  SELECT lower(regexp_extract(categories, '[^ \t\r\n,;]+', 0)) AS cat, CASE WHEN numeric_signal THEN 1 ELSE 0 END AS numeric_flag FROM latest
), kept AS (
  SELECT cat, numeric_flag, count(*) AS papers FROM firsts
  WHERE cat IN (SELECT lower(category) FROM target_shares) GROUP BY cat, numeric_flag
), total AS (
  SELECT CAST(floor(coalesce(sum(papers), 0) / 4) AS BIGINT) AS n FROM kept
)
SELECT t.category, t.numeric_flag
FROM target_shares AS t CROSS JOIN total LEFT JOIN kept AS k ON k.cat = lower(t.category) AND k.numeric_flag = t.numeric_flag
WHERE coalesce(k.papers, 0) < greatest(CAST(t.min_rows AS BIGINT), CAST(floor((total.n * t.share_pm + 500) / 1000) AS BIGINT))
"""
