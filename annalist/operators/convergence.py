"""Prompts and trajectories as events of one shape, and bounded batches of them for export.

Source documents are JSON of loose shape, read as VARIANT. Each trajectory makes an array of events, in a fixed
order, which is exploded; nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S

MAX_RECORDS = 900
EVENT = ("source_row", "ord", "v", "kind", "source", "lens", "session_id", "event_id", "ts", "type", "content", "confidence", "tags", "actor_name", "project_id", "task_title", "task_description", "task_status", "record")
_ITEM = "struct<kind:string,name:string,content:string,confidence:double,record:string>"


def _kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _string(v: Column, key: str) -> Column:
    """A string value without white space around it; null if it is another type or empty."""
    return F.when(_kind_of(_get(v, key)) == "STRING", S.non_empty(F.try_variant_get(v, f"$.{key}", "string")))


def _number(v: Column, key: str) -> Column:
    kind = _kind_of(_get(v, key))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, f"$.{key}", "double"))


def _array(v: Column, key: str) -> Column:
    return F.coalesce(F.when(F.startswith(_kind_of(_get(v, key)), F.lit("ARRAY")), F.try_variant_get(v, f"$.{key}", "array<variant>")), F.array().cast("array<variant>"))


def _text_of(item: Column) -> Column:
    kind = _kind_of(item)
    return F.when(kind == "STRING", S.non_empty(F.try_variant_get(item, "$", "string"))).when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(*(_string(item, k) for k in ("text", "summary", "description", "value"))))


def _strings(v: Column, key: str) -> Column:
    return F.filter(F.transform(_array(v, key), _text_of), lambda x: x.isNotNull())


def _alternatives(d: Column) -> Column:
    """Alternatives as texts: strings, or `option (reason)`."""

    def told(a):
        option, reason = _string(a, "option"), _string(a, "reason")
        both = F.when(option.isNotNull() & reason.isNotNull(), F.concat(option, F.lit(" ("), reason, F.lit(")"))).otherwise(F.coalesce(option, reason))
        return F.when(_kind_of(a) == "STRING", S.non_empty(F.try_variant_get(a, "$", "string"))).when(F.startswith(_kind_of(a), F.lit("OBJECT")), both)

    return F.filter(F.transform(_array(d, "alternatives"), told), lambda x: x.isNotNull())


def _labelled(v: Column, *fields: tuple[str, str]) -> Column:
    return F.concat_ws("\n", *(F.when(_string(v, key).isNotNull(), F.concat(F.lit(f"{label}: "), _string(v, key))) for label, key in fields))


_DECISION = (("Question", "question"), ("Chose", "chosen"), ("Because", "reasoning"))


def _item(kind: str, name: Column, content: Column, confidence: Column | None = None, record: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), S.non_empty(S.home_as_tilde(S.strip(content))).alias("content"),
        (none.cast("double") if confidence is None else confidence).alias("confidence"), (none.cast("string") if record is None else record).alias("record"),
    )


def _decision(d: Column, i: Column) -> Column:
    others = _alternatives(d)
    content = F.concat_ws("\n", F.nullif(_labelled(d, *_DECISION), F.lit("")), F.when(F.size(others) > 0, F.concat(F.lit("Alternatives: "), F.array_join(others, "; "))))
    kept = F.struct(S.home_as_tilde(_string(d, "chosen")).alias("chosen"), F.when(F.size(others) > 0, F.transform(others, S.home_as_tilde)).alias("alternatives"))
    return _item("decision", F.concat(F.lit(""), i.cast("string")), content, _number(d, "confidence"), F.nullif(F.to_json(kept), F.lit("{}")))


def _rolled_decision(d: Column, i: Column) -> Column:
    kept = F.struct(S.home_as_tilde(_string(d, "chosen")).alias("chosen"), S.home_as_tilde(_string(d, "impact")).alias("impact"))
    return _item("decision", i.cast("string"), _labelled(d, *_DECISION, ("Impact", "impact")), None, F.nullif(F.to_json(kept), F.lit("{}")))


def _numbered(items: Column, kind: str, name: str, content=lambda x: x) -> Column:
    return F.transform(items, lambda x, i: _item(kind, F.concat(F.lit(f"{name}:"), i.cast("string")), content(x)))


def _one(kind: str, name: str, content: Column, confidence: Column | None = None) -> Column:
    return F.when(content.isNotNull(), F.array(_item(kind, F.lit(name), content, confidence))).otherwise(F.array().cast(f"array<{_ITEM}>"))


def prompt_events(history: DataFrame) -> DataFrame:
    """One event per prompt; prompts without a session are `unsessioned`."""
    none = F.lit(None).cast("string")
    digest = F.coalesce("prompt_hash", S.prompt_hash(F.col("prompt"))) if "prompt_hash" in history.columns else S.prompt_hash(F.col("prompt"))
    return history.select(
        F.col("id").alias("source_row"), F.lit(0).alias("ord"), F.lit(1).alias("v"), F.lit("prompt").alias("kind"), "source", F.lit("history").alias("lens"),
        F.coalesce("session_id", F.lit("unsessioned")).alias("session_id"), F.concat(F.lit("prompt:"), F.col("timestamp_ms").cast("string"), F.lit(":"), digest).alias("event_id"),
        S.iso_time(F.col("timestamp_ms")).alias("ts"), F.lit("prompt").alias("type"), S.home_as_tilde(S.strip(F.col("prompt"))).alias("content"), F.lit(None).cast("double").alias("confidence"),
        F.array().cast("array<string>").alias("tags"), *(none.alias(c) for c in ("actor_name", "project_id", "task_title", "task_description", "task_status", "record")),
    )


def trajectory_events(trajectories: DataFrame) -> DataFrame:
    """Events of each trajectory in their order; a roll-up makes those of its own kind. Without an id there are none."""
    retro, decisions = F.try_parse_json(F.col("retrospective_json")), F.try_parse_json(F.col("decisions_json"))
    rows = trajectories.where(S.non_empty(F.col("id")).isNotNull()).withColumns({"_r": retro, "_d": decisions})
    r, d = F.col("_r"), F.col("_d")
    rolled = F.coalesce((_string(r, "type") == "compacted") & F.startswith(_kind_of(_get(r, "sourceTrajectories")), F.lit("ARRAY")), F.lit(False))
    sure = _number(r, "confidence")
    top = F.coalesce(F.when(F.startswith(_kind_of(d), F.lit("ARRAY")), F.try_variant_get(d, "$", "array<variant>")), F.array().cast("array<variant>"))
    run = F.concat(
        F.transform(top, _decision), _one("reflection", "summary", _string(r, "summary"), sure), _one("reflection", "approach", _string(r, "approach"), sure),
        _numbered(_strings(r, "learnings"), "finding", "learning"), _numbered(_strings(r, "suggestions"), "reflection", "suggestion"), _numbered(_strings(r, "challenges"), "finding", "challenge"),
    )

    def objects(key):
        return F.filter(_array(r, key), lambda x: F.startswith(_kind_of(x), F.lit("OBJECT")))

    own_tags = F.filter(F.transform(_array(r, "tags"), lambda x: F.when(_kind_of(x) == "STRING", S.non_empty(F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull())
    tags = F.when(F.size(own_tags) > 0, own_tags).otherwise(F.array(F.lit("compacted")))
    narrative = F.when(~F.array_contains(tags, "learn"), _string(r, "narrative"))
    roll = F.concat(
        F.transform(_array(r, "decisions"), _rolled_decision),
        _numbered(objects("lessons"), "reflection", "lesson", lambda x: _labelled(x, ("Context", "context"), ("Lesson", "lesson"), ("Recommendation", "recommendation"))),
        _numbered(_strings(r, "keyFindings"), "finding", "keyfinding"), _numbered(_strings(r, "keyLearnings"), "finding", "learning"),
        _numbered(objects("conventions"), "reflection", "convention", lambda x: _labelled(x, ("Pattern", "pattern"), ("Rationale", "rationale"), ("Scope", "scope"))),
        _one("reflection", "summary", narrative), _numbered(_strings(r, "openQuestions"), "finding", "openquestion"),
    )
    source = F.when(rolled, F.coalesce(_string(r, "source"), F.lit("trajectories"))).otherwise("trajectories")
    events = F.filter(F.when(rolled, roll).otherwise(run), lambda e: e["content"].isNotNull())
    rows = rows.select(
        F.col("rowid").alias("source_row") if "rowid" in trajectories.columns else F.lit(None).cast("long").alias("source_row"), S.strip(F.col("id")).alias("session_id"), "timestamp_ms", source.alias("source"),
        F.when(rolled, F.coalesce(_string(r, "lens"), source)).otherwise("trajectories").alias("lens"), F.when(rolled, tags).otherwise(F.array().cast("array<string>")).alias("tags"),
        *(S.non_empty(F.col(c)).alias(n) for c, n in (("persona_id", "actor_name"), ("project_id", "project_id"), ("task_title", "task_title"), ("task_description", "task_description"), ("status", "task_status"))),
        F.posexplode(events).alias("ord", "e"),
    )
    return rows.select(
        "source_row", "ord", F.lit(1).alias("v"), F.col("e.kind").alias("kind"), "source", "lens", "session_id", F.concat(F.col("e.kind"), F.lit(":"), "session_id", F.lit(":"), F.col("e.name")).alias("event_id"),
        S.iso_time(F.col("timestamp_ms")).alias("ts"), F.col("e.kind").alias("type"), F.col("e.content").alias("content"), F.col("e.confidence").alias("confidence"), "tags",
        "actor_name", "project_id", "task_title", "task_description", "task_status", F.col("e.record").alias("record"),
    )


def outbox_batch(history: DataFrame, trajectories: DataFrame, history_id: int, trajectory_rowid: int, limit: int = 500, incognito: DataFrame | None = None, cap: int = MAX_RECORDS) -> tuple[DataFrame, dict[str, int]]:
    """The events after two cursors, `cap` at most, and the cursors after them.

    Suppressed sessions (incognito: session_id) send nothing but move the cursor. A trajectory that would pass the
    cap waits for the next batch, unless it would be the first record. Both windows run over `limit` rows.
    """
    limit = max(1, limit)
    hidden = incognito if incognito is not None else history.select("session_id").limit(0)
    hidden = hidden.select("session_id").where("session_id is not null").distinct().withColumn("_hidden", F.lit(True))
    rows = history.where(F.col("id") > history_id).orderBy("id").limit(limit).join(hidden, "session_id", "left").withColumn("emits", F.when(F.col("_hidden"), 0).otherwise(1))
    before = F.coalesce(F.sum("emits").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") < cap)
    head = rows.agg(F.max("id").alias("id"), F.coalesce(F.sum("emits"), F.lit(0)).alias("n")).first()
    cursors = {"history_id": max(history_id, head.id or history_id), "trajectory_rowid": trajectory_rowid}

    runs = trajectories.where(F.col("rowid") > trajectory_rowid).orderBy("rowid").limit(limit).join(hidden.withColumnRenamed("session_id", "id"), "id", "left")
    events = trajectory_events(runs.where("_hidden is null").drop("_hidden"))
    sizes = runs.select("rowid").join(events.groupBy(F.col("source_row").alias("rowid")).agg(F.count("*").alias("n")), "rowid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = F.sum("n").over(Window.orderBy("rowid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(head.n)
    over = sizes.withColumn("upto", upto).withColumn("bad", ((F.col("n") > 0) & (F.col("upto") > cap) & (F.col("upto") > F.col("n"))) | ((F.col("n") == 0) & (F.col("upto") > cap)))
    stop = over.where("bad").agg(F.min("rowid")).first()[0]
    sent = sizes if stop is None else sizes.where(F.col("rowid") < stop)
    last = sent.agg(F.max("rowid")).first()[0]
    cursors["trajectory_rowid"] = max(trajectory_rowid, last or trajectory_rowid)
    out = prompt_events(rows.where("emits = 1").drop("_hidden", "emits", "before")).unionByName(events.where(F.col("source_row") <= cursors["trajectory_rowid"]))
    return out.select(*EVENT), cursors


def push(history: DataFrame, trajectories: DataFrame, cursors: dict[str, int], send, machine: str, limit: int = 500, incognito: DataFrame | None = None, rounds: int = 1000) -> dict[str, int]:
    """Sends batches until nothing is left. send(batch_id, events) raises OverflowError where it can't take so many,
    upon which the limit is halved and the batch sent again from the same cursors, which move only after a send."""
    spark = history.sparkSession
    for _ in range(rounds):
        events, after = outbox_batch(history, trajectories, cursors["history_id"], cursors["trajectory_rowid"], limit, incognito)
        if after == cursors:
            break
        n = events.count()
        if n:
            parts = [F.lit(x) for x in (machine, cursors["history_id"], after["history_id"], cursors["trajectory_rowid"], after["trajectory_rowid"], n)]
            name = spark.range(1).select(S.batch_id(*parts)).first()[0]
            try:
                send(name, events)
            except OverflowError:
                if limit == 1:
                    raise
                limit = max(1, limit // 2)
                continue
        cursors = {k: max(cursors[k], after[k]) for k in cursors}
    return cursors
