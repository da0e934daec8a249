"""Recorded search-and-answer trajectories replayed: observations, state, segments and masks.

All queries of all turns are known, so they are retrieved in one batch; each trajectory, a few turns, then runs through
the state machine on its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import action, until_action
from millrace.operators.retrieval import Index, passages

HINT = "\nThe last action was not valid. A search belongs between <search> and </search>, the final answer between <answer> and </answer>.\n"
NOTHING = "No relevant documents found."
ACTION = re.compile(r"<(search|answer)>(.*?)</\1>", re.S)
STATE = "traj_id string, seg int, owner string, text string, n_tokens int, mask int, turns int, valid_actions int, searches int, answered boolean, invalid_actions int"


def observed(turns: DataFrame, index: Index, papers: DataFrame, k: int = 3) -> DataFrame:
    """turns (traj_id, turn, text, exclude_id) cut at their action, with `seen`: the passages of a search, null otherwise."""
    t = turns.withColumn("text", until_action(F.col("text"))).withColumn("a", action(F.col("text")))
    key = F.concat_ws("|", F.col("traj_id").cast("string"), F.col("turn").cast("string"))
    asked = t.where("a.kind = 'search'").select(key.alias("qid"), F.col("a.content").alias("text"), "exclude_id")
    found = passages(index.search(asked, k), papers).withColumnRenamed("text", "found")
    return t.withColumn("qid", key).join(found, "qid", "left").select("traj_id", "turn", "text", F.when(F.col("a.kind") == "search", F.coalesce("found", F.lit(NOTHING))).alias("seen"))


def replay(steps: list[tuple[str, str | None]], max_turns: int, budget: int, seen_tokens: int, split: Callable[[str], list[str]]) -> tuple[list[tuple], dict]:
    """((owner, text, n_tokens, mask) segments, state) of the (text, passages) of one trajectory's turns.

    Turn max_turns + 1 is the last: there a search or an invalid action only counts as a turn. What exceeds the budget is
    cut; an observation keeps its closing tag, only the passages in it are cut.
    """
    out: list[tuple] = []
    state = {"turns": 0, "valid_actions": 0, "searches": 0, "answered": False, "invalid_actions": 0}
    used = 0

    def put(owner: str, text: str, mask: int) -> None:
        nonlocal used
        parts = split(text)[: budget - used]
        used += len(parts)
        out.append((owner, "".join(parts), len(parts), mask))

    for turn, (text, seen) in enumerate(steps[: max_turns + 1]):
        if used >= budget:
            break
        put("model", text, 1)
        found = ACTION.search(text)
        kind = found[1] if found else None
        state["turns"] += 1
        last = turn == max_turns
        if kind == "answer":
            state["valid_actions"] += 1
            state["answered"] = True
            break
        if last:
            break
        if kind == "search":
            state["valid_actions"] += 1
            state["searches"] += 1
            reply = f"\n\n<information>{''.join(split(seen or NOTHING)[:seen_tokens])}</information>\n\n"
        else:
            state["invalid_actions"] += 1
            reply = HINT
        if used < budget:
            put("environment", reply, 0)
    return out, state


def letters(text: str) -> list[str]:
    return list(text)


def replayed(steps: DataFrame, max_turns: int = 3, budget: int = 1024, seen_tokens: int = 400, split: Callable[[str], list[str]] = letters) -> DataFrame:
    """STATE rows of observed() turns, one per segment."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        segs, state = replay([(t or "", None if pd.isna(s) else s) for t, s in zip(rows["text"], rows["seen"])], max_turns, budget, seen_tokens, split)
        return pd.DataFrame([(str(key[0]), i, *s, *state.values()) for i, s in enumerate(segs)], columns=[c.split()[0] for c in STATE.split(", ")])

    return steps.groupBy("traj_id").applyInPandas(run, STATE)


def padded(parts: Iterator[list[int]], pad: int, left: bool = False) -> list[list[int]]:
    """Lists of one batch filled to the longest with `pad`, at the end or at the start."""
    rows = list(parts)
    width = max([1, *map(len, rows)])
    return [[pad] * (width - len(r)) + r if left else r + [pad] * (width - len(r)) for r in rows]
