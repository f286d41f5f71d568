"""Sessions distilled into roll-ups: transcripts cut to a budget, and documents built from a model's answer.

The model itself is a function that the caller gives; nothing here calls a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators.convergence import _array, _get, _kind_of, _string

BUDGET = 60_000
MOST_OF_A_PART = 4_000
#: The keys of an object under which texts are looked for, in this order, and how far.
TEXT_KEYS = ("message", "content", "text", "display", "result", "stdout", "stderr", "command", "input", "summary", "toolUseResult")
TEXT_DEPTH, MOST_TEXTS = 8, 201


def text_fields(v: Column, depth: int = TEXT_DEPTH) -> Column:
    """The texts of over two bytes inside a variant, in order: of arrays all entries, of objects TEXT_KEYS, `depth` levels down."""
    return F.slice(_texts_inside(v, depth), 1, MOST_TEXTS)


def _texts_inside(v: Column, depth: int) -> Column:
    kind, none = _kind_of(v), F.array().cast("array<string>")
    text = S.strip(F.try_variant_get(v, "$", "string"))
    own = F.when(kind == "STRING", F.when(F.octet_length(text) > 2, F.array(F.substring(text, 1, MOST_OF_A_PART))).otherwise(none))
    if depth == 0:
        return F.coalesce(own, none)
    inside = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), F.filter(F.array(*(_get(v, k) for k in TEXT_KEYS)), lambda x: x.isNotNull()))
    return F.coalesce(own, F.flatten(F.transform(inside, lambda x: _texts_inside(x, depth - 1))), none)


def raw_transcripts(lines: DataFrame, budget: int = BUDGET) -> DataFrame:
    """path, transcript: the texts of raw transcripts' lines (path, line, v) under `### role time`, until the budget is reached.

    The line that reaches the budget is the last. Lines that aren't JSON, or hold no text, count for nothing.
    """
    v = F.col("v")
    named = F.coalesce(_get(v, "type"), _get(v, "role"))
    role = F.coalesce(F.when(_kind_of(named) == "STRING", F.try_variant_get(named, "$", "string")), F.lit("event"))
    at, kind = _get(v, "timestamp"), _kind_of(_get(v, "timestamp"))
    time = F.coalesce(F.when(kind == "STRING", F.try_variant_get(at, "$", "string")).when(F.startswith(kind, F.lit("BIGINT")), S.iso_offset_time(F.try_variant_get(at, "$", "long"))), F.lit(""))
    text = S.strip(F.array_join(text_fields(v), "\n"))
    part = F.concat(F.lit("### "), role, F.lit(" "), time, F.lit("\n"), S.home_as_tilde(text))
    rows = lines.where("v is not null").where(text != "").select("path", "line", part.alias("part"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))).where(F.col("before") < budget)
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n\n").alias("transcript"))


def transcripts(events: DataFrame, budget: int = BUDGET) -> DataFrame:
    """source, session_id, transcript: events as `[role time] text`, in order, until the budget of characters is reached.

    The event that reaches the budget is the last. The sum runs in a window over a session's events.
    """
    part = F.concat(F.lit("["), F.col("role"), F.lit(" "), S.iso_time(F.col("ts_ms")), F.lit("] "), F.substring("text", 1, MOST_OF_A_PART))
    rows = events.where(F.coalesce("text", F.lit("")) != "").select("source", "session_id", "ts_ms", "id", part.alias("part"))
    before = Window.partitionBy("source", "session_id").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))).where(F.col("before") < budget)
    return rows.groupBy("source", "session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "id", "part"))), lambda x: x["part"]), "\n").alias("transcript"))


def _objects(v: Column, key: str, *fields: str) -> Column:
    return F.transform(_array(v, key), lambda x: F.struct(*(_string(x, f).alias(f) for f in fields)))


def _texts(v: Column, key: str) -> Column:
    return F.filter(F.transform(_array(v, key), lambda x: S.non_empty(F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())


def roll_ups(answers: DataFrame, now_ms: int) -> DataFrame:
    """Trajectory rows from answers (source, session_id, project, answer: JSON, maybe fenced); bad JSON makes none."""
    rows = answers.withColumn("v", F.try_parse_json(S.unfenced_json(F.col("answer")))).where("v is not null")
    v = F.col("v")
    name = F.concat(F.lit("learn_"), S.prompt_hash(F.concat_ws(":", "source", "session_id")))
    doc = F.struct(
        name.alias("id"), F.lit("compacted").alias("type"), F.array("session_id").alias("sourceTrajectories"), F.array(F.lit("learn")).alias("tags"), S.iso_time(F.lit(now_ms)).alias("compactedAt"),
        _objects(v, "decisions", "question", "chosen", "reasoning", "impact").alias("decisions"), _objects(v, "lessons", "context", "lesson", "recommendation").alias("lessons"),
        _texts(v, "keyFindings").alias("keyFindings"), _texts(v, "keyLearnings").alias("keyLearnings"), _objects(v, "conventions", "pattern", "rationale", "scope").alias("conventions"), _string(v, "narrative").alias("narrative"),
    )
    return rows.select(name.alias("id"), F.lit(1).cast("long").alias("version"), F.col("project").alias("project_id"), _string(v, "title").alias("task_title"), F.to_json(doc).alias("retrospective_json"), F.coalesce(_string(v, "narrative"), F.lit("")).alias("search_text"), F.lit(now_ms).cast("long").alias("updated_ms"), F.lit(now_ms).cast("long").alias("timestamp_ms"))


def event_estimate(rolls: DataFrame) -> DataFrame:
    """id, events: how many events a roll-up will make, from the lengths of its lists."""
    v = F.try_parse_json("retrospective_json")
    total = F.lit(0)
    for key in ("decisions", "lessons", "keyFindings", "keyLearnings", "conventions"):
        total = total + F.size(_array(v, key))
    return rolls.select("id", total.alias("events"))


def merged_roll_ups(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with fresh roll-ups by id: a known one keeps its own persona, status, dates and decisions."""
    kept = [c for c in stored.columns if c not in fresh.columns]
    new = fresh.join(stored.select("id", *kept), "id", "left").select(*stored.columns)
    return stored.join(fresh.select("id"), "id", "left_anti").select(*stored.columns).unionByName(new)


def distil(events: DataFrame, candidates: DataFrame, ask, now_ms: int, budget: int = BUDGET) -> DataFrame:
    """Roll-ups of candidate sessions. ask(DataFrame with transcript) returns it with a column `answer`."""
    chosen = transcripts(events.join(candidates.select("source", "session_id"), ["source", "session_id"], "left_semi"), budget)
    return roll_ups(ask(chosen.join(candidates.select("source", "session_id", "project"), ["source", "session_id"])), now_ms)
