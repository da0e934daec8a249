"""Model calls as a source: any function of a batch of prompts, run per partition, with one retry for invalid answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.evaluate import reading

Call = Callable[[list[str], float], list[str | None]]


def prompts(instruction: str, examples: list[tuple[str, str]]) -> Column:
    """Messages for a row with title and abstract: the instruction, worked examples, then the paper."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = [say(role, F.lit(text)) for pair in examples for role, text in zip(("user", "assistant"), pair)]
    paper = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit("")))
    return F.array(say("system", F.lit(instruction)), *shots, say("user", paper))


def called(df: DataFrame, key: str, prompt: str, call: Call, temperature: float, batch: int = 8) -> DataFrame:
    """(key, raw) with the answers to the prompts (any column, as JSON); a failed batch gives null answers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                try:
                    raw = call(some["prompt"].tolist(), temperature)
                except OSError:
                    raw = [None] * len(some)
                yield pd.DataFrame({key: some[key], "raw": raw})

    kind = dict(df.dtypes)[key]
    text = F.col(prompt) if dict(df.dtypes)[prompt] == "string" else F.to_json(prompt)
    return df.select(key, text.alias("prompt")).mapInPandas(run, f"{key} {kind}, raw string")


def labelled(df: DataFrame, key: str, prompt: str, call: Call, first: float = 0.0, second: float = 0.6) -> DataFrame:
    """(key, r, raw, temperature): each prompt asked once, and again, warmer, where the answer is invalid.

    The second answer is taken only if it is not invalid; the raw text kept of a row that stays invalid is the first one.
    """
    one = called(df, key, prompt, call, first).withColumn("r", reading("raw"))
    again = called(df.join(one.where("r.status = 'INVALID'").select(key), key), key, prompt, call, second).select(key, F.col("raw").alias("raw2"), reading("raw").alias("r2"))
    better = F.coalesce(F.col("r2.status") != "INVALID", F.lit(False))
    pick = lambda a, b: F.when(better, F.col(b)).otherwise(F.col(a))
    return one.join(again, key, "left").select(key, pick("r", "r2").alias("r"), pick("raw", "raw2").alias("raw"), F.when(better, second).otherwise(first).alias("temperature"))
