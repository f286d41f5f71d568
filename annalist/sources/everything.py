"""All sources that a machine has, as one DataFrame of prompts: the readers' rows in one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators.store import first_wins
from annalist.schemas import KEYS
from annalist.sources import logs, sqlite

PROMPT = ("source", "session_id", "project", "prompt", "prompt_hash", "timestamp_ms", "git_branch")


def trajectory_prompts(runs: DataFrame) -> DataFrame:
    """Trajectories as prompts, found by their search text."""
    text = F.col("search_text")
    rows = runs.where(text != "").select(F.lit("trajectory").alias("source"), F.col("id").alias("session_id"), F.col("project_id").alias("project"), text.alias("prompt"), S.prompt_hash(text).alias("prompt_hash"), "timestamp_ms", F.lit(None).cast("string").alias("git_branch"))
    return rows


def trajectory_roots(spark: SparkSession, roots: list[str], roll_ups: bool = True) -> DataFrame:
    """Trajectories of several roots; files that two roots reach count once, and only those below a .trajectories folder of a wider root."""
    parts = [logs.trajectories(spark, r, roll_ups) for r in dict.fromkeys(roots)]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])


def prompts(spark: SparkSession, places: dict[str, str | list[str]]) -> DataFrame:
    """Prompts of all sources of `places`, which names a folder (or file, or list of roots) for each source; the first of a key wins.

    Keys: claude, codex, codex_rollouts, cursor, grok, opencode (a SQLite file), trajectory (roots).
    """
    rolls = logs.codex_rollouts(spark, places["codex_rollouts"]) if "codex_rollouts" in places else None
    readers = {
        "claude": lambda p: logs.claude_prompts(logs.json_lines(spark, p)),
        "codex": lambda p: logs.codex_prompts(logs.json_lines(spark, p), rolls),
        "cursor": lambda p: logs.cursor_prompts(logs.json_lines(spark, p)),
        "grok": lambda p: logs.grok_sessions(spark, p)[0],
        "opencode": lambda p: logs.opencode_prompts(*sqlite.opencode(spark, p)),
        "trajectory": lambda p: trajectory_prompts(trajectory_roots(spark, [p] if isinstance(p, str) else p)),
    }
    if unknown := set(places) - {*readers, "codex_rollouts"}:
        raise ValueError(f"unknown sources {sorted(unknown)}; known: {', '.join(readers)}")
    parts = [readers[k](v).select(*PROMPT) for k, v in places.items() if k in readers]
    if not parts:
        raise ValueError("no source is named")
    rows = reduce(DataFrame.unionByName, parts).withColumn("seq", F.struct("session_id", "project", "git_branch"))
    return first_wins(rows, KEYS["history"]).drop("seq")
