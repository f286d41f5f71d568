"""Sessions: summaries, statistics, hand-off candidates, coverage of machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators.search import scoped
from annalist.operators.tags import with_tag


def list_sessions(history: DataFrame, limit: int | None = 50, **filters) -> DataFrame:
    """A row per session: first prompt, number of prompts, first and last time; one aggregation, no window.

    The first prompt is kept by the aggregation itself, so a session of any length is combined in its tasks first.
    """
    rows = scoped(history, **filters).where(F.coalesce("session_id", F.lit("")) != "")
    out = rows.groupBy("session_id", "source", "project").agg(
        F.min(F.struct("timestamp_ms", "id", "prompt")).alias("first"), F.count("*").alias("entry_count"), F.max("timestamp_ms").alias("last_activity_ms")
    )
    out = out.select("session_id", "source", "project", F.col("first.prompt").alias("first_prompt"), "entry_count", F.col("first.timestamp_ms").alias("first_activity_ms"), "last_activity_ms")
    return out if limit is None else out.orderBy(F.desc("last_activity_ms"), "session_id", "source", "project").limit(limit)


def session_window(history: DataFrame) -> DataFrame:
    """The same by windows, as a session's first row with its partition's counts."""
    own = Window.partitionBy("session_id", "source", "project")
    rows = history.where(F.coalesce("session_id", F.lit("")) != "")
    rows = rows.select("session_id", "source", "project", F.col("prompt").alias("first_prompt"), F.count("*").over(own).alias("entry_count"), F.min("timestamp_ms").over(own).alias("first_activity_ms"), F.max("timestamp_ms").over(own).alias("last_activity_ms"), F.row_number().over(own.orderBy("timestamp_ms", "id")).alias("nth"))
    return rows.where("nth = 1").drop("nth")


def stats_total(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("total"))


def stats_by_source(history: DataFrame) -> DataFrame:
    return history.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def stats_top_projects(history: DataFrame, k: int = 10, non_empty: bool = False) -> DataFrame:
    rows = history.where(F.col("project").isNotNull())
    rows = rows.where(F.col("project") != "") if non_empty else rows
    return rows.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(k)


def stats_range(history: DataFrame) -> DataFrame:
    return history.agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def stats(history: DataFrame, session_tags: DataFrame | None = None, tags: DataFrame | None = None, tag: str | None = None, scope: str | None = None) -> DataFrame:
    """Total, range, counts by source and top projects in one row, from one scan summed by source and project.

    tag: of sessions with the tag only; scope: of projects equal to a folder or below it only.
    """
    rows = history if tag is None else with_tag(history, session_tags, tags, tag)
    rows = rows if scope is None else rows.where(S.within(F.col("project"), scope))
    parts = rows.groupBy("source", "project").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("lo"), F.max("timestamp_ms").alias("hi"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("lo").alias("first_ms"), F.max("hi").alias("last_ms"))
    sources = parts.groupBy("source").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    top = parts.where("project <> ''").groupBy("project").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "project").limit(10)
    top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "project"))), lambda x: F.struct(x["project"].alias("project"), (-x["k"]).alias("n"))).alias("by_project"))
    one = [x.withColumn("_one", F.lit(1)) for x in (total, sources, top)]
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")


def matching_sessions(history: DataFrame, session_id: str | None = None, source: str | None = None) -> DataFrame:
    rows = scoped(history, source).where(F.coalesce("session_id", F.lit("")) != "")
    rows = rows if session_id is None else rows.where(F.col("session_id") == session_id)
    return rows.groupBy("source", "session_id").agg(F.min("project").alias("project"), F.count("*").alias("n"), F.max("timestamp_ms").alias("last_ms"))


def session_size(history: DataFrame) -> DataFrame:
    return history.where(F.coalesce("session_id", F.lit("")) != "").groupBy("source", "session_id").agg(F.count("*").alias("n"))


def handoff(sessions: DataFrame, history: DataFrame, limit: int = 3, source: str | None = None, repo: str | None = None, branch: str | None = None, scope: str | None = None) -> DataFrame:
    """Sessions that another tool could go on with, the surest first.

    Of the newest min(5 * limit, 100) sessions those with prompts count, and the first `limit` of them are scored.
    """
    rows = scoped(sessions, source)
    if scope:
        rows = rows.where(F.startswith(S.ascii_lower(F.col("cwd")), F.lit(S.lower_a_z(scope))))
    if repo:
        rows = rows.where(S.contains_ascii(F.col("cwd"), repo))
    if branch:
        rows = rows.where(S.contains_ascii(F.col("git_branch"), branch))
    newest = [F.desc("last_activity_ms"), "session_id", "source"]
    top = rows.orderBy(*newest).limit(min(max(5 * limit, limit), 100))
    prompts = history.join(F.broadcast(top.select("session_id", "source")), ["session_id", "source"], "left_semi")  # 100 rows at most
    plain = ~S.is_boilerplate(F.col("prompt"))
    order = F.struct("timestamp_ms", "id")
    told = prompts.groupBy("session_id", "source").agg(
        F.count("*").alias("prompt_count"),
        F.coalesce(F.min_by("prompt", F.when(plain, order)), F.min_by("prompt", order)).alias("goal"),
        F.max_by("prompt", order).alias("last_state"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_ms", "id", "prompt"))), lambda x: x["prompt"]), "\n").alias("all_prompts"),
    )
    line = {c: F.replace(F.substring(F.col(c), 1, 300), F.lit("\n"), F.lit(" ")) for c in ("goal", "last_state")}
    out = top.join(told, ["session_id", "source"]).orderBy(*newest).limit(limit).withColumns(line).withColumn("files", S.file_paths(F.col("all_prompts")))
    sure = F.least(F.lit(0.6), F.lit(0.2) + F.col("prompt_count") * 0.02)
    if branch:
        sure = sure + F.when(F.contains("git_branch", F.lit(branch)), 0.25).otherwise(0.0)
    if repo:
        sure = sure + F.when(F.contains("cwd", F.lit(repo)), 0.15).otherwise(0.0)
    last = F.col("last_assistant_text") if "last_assistant_text" in sessions.columns else F.lit(None).cast("string")
    picture = F.concat(
        F.lit("Picking up from previous session. Goal: "), F.col("goal"), F.lit("."),
        F.when(F.size("files") > 0, F.concat(F.lit(" Files touched: "), F.array_join(F.slice("files", 1, 10), ", "), F.lit("."))).otherwise(""),
        F.lit(" Last user prompt: "), F.col("last_state"), F.lit("."),
        F.when(F.coalesce(last, F.lit("")) != "", F.concat(F.lit(" Last assistant state: "), F.substring(F.replace(last, F.lit("\n"), F.lit(" ")), 1, 200))).otherwise(""),
    )
    target = F.when(F.col("source") == "claude", F.lit("codex")).otherwise(F.lit("claude"))
    folder = F.when(F.coalesce("cwd", F.lit("")) != "", F.concat(F.lit("cd "), S.shell_quoted(F.col("cwd")), F.lit(" && "))).otherwise("")
    return out.select(
        "session_id", "source", "cwd", "git_branch", "first_activity_ms", "last_activity_ms", "prompt_count", "goal", "last_state", "files",
        S.resume_command(F.col("source"), F.col("session_id"), F.col("cwd")).alias("resume"),
        F.concat(folder, target, F.lit(" "), S.shell_quoted(picture)).alias("warm_start"),
        F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"),
    ).orderBy(F.desc("confidence"), *newest)


def fleet_coverage(beats: DataFrame, now_ms: int, stale_s: int = 900, missing_s: int = 86_400) -> DataFrame:
    """machine_id, last_ms, age_s, status: active, stale or missing by the age of a machine's last record."""
    last = beats.groupBy("machine_id").agg(F.max("ts_ms").alias("last_ms"), F.count("*").alias("records"))
    age = F.floor((F.lit(now_ms) - F.col("last_ms")) / 1000)
    return last.select("machine_id", "last_ms", "records", age.alias("age_s"), F.when(age >= missing_s, "missing").when(age >= stale_s, "stale").otherwise("active").alias("status"))


def fleet_summary(beats: DataFrame, now_ms: int, **limits) -> DataFrame:
    return fleet_coverage(beats, now_ms, **limits).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("active", "stale", "missing")))


def learn_candidates(history: DataFrame, sessions: DataFrame, limit: int = 10) -> DataFrame:
    """Sessions to distil, the newest first, with their transcript's path and last answer where known."""
    rows = history.where(F.coalesce("session_id", F.lit("")) != "").groupBy("source", "session_id").agg(F.min("project").alias("project"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))
    known = sessions.select("source", "session_id", "raw_path", "last_assistant_text")
    return rows.join(known, ["source", "session_id"], "left").orderBy(F.desc("last_ms"), "session_id", "source").limit(max(1, limit))


def codex_backfill(history: DataFrame, rollouts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions whose prompts or summary lack what the rollout map knows: one aggregate, and a filter on it."""
    rows = history.where((F.col("source") == "codex") & F.col("session_id").isNotNull()).join(rollouts.select("session_id", F.col("cwd").alias("map_cwd"), F.col("git_branch").alias("map_branch")), "session_id")
    known = sessions.where(F.col("source") == "codex").select("session_id", F.col("cwd").alias("own_cwd"), F.col("git_branch").alias("own_branch"))
    out = rows.join(known, "session_id", "left").groupBy("session_id", "map_cwd", "map_branch", "own_cwd", "own_branch").agg(
        F.count_if(F.col("project").isNull()).alias("no_project"), F.count_if(F.col("git_branch").isNull()).alias("no_branch"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms")
    )
    lacking = (F.col("no_project") > 0) | ((F.col("no_branch") > 0) & F.col("map_branch").isNotNull()) | F.col("own_cwd").isNull() | (F.col("own_branch").isNull() & F.col("map_branch").isNotNull())
    return out.where(lacking).select("session_id", "map_cwd", "map_branch", "no_project", "no_branch", "first_ms", "last_ms")
