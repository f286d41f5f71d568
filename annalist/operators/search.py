"""Searching and browsing prompts and session events. Every order ends with the id, so that limits are stable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import fts
from annalist.functions import scalars as S
from annalist.schemas import check_source
from annalist.work import written

ENTRY = ("id", "source", "session_id", "project", "prompt", "timestamp_ms")


def scoped(df: DataFrame, source: str | None = None, project: str | None = None, mode: str = "like", before_ms: int | None = None, since: str | None = None, time: str = "timestamp_ms") -> DataFrame:
    """Filters that reach the scan: source, time, and project by mode: like (wildcards live), exact, scope, prefix."""
    if check_source(source):
        df = df.where(F.col("source") == source)
    if project is not None:
        column = F.col("project")
        how = {"like": lambda: S.like_ascii(column, project), "exact": lambda: column == project, "scope": lambda: S.within(column, project), "prefix": lambda: F.startswith(column, F.lit(project))}
        df = df.where(how[mode]())
    if before_ms is not None:
        df = df.where(F.col(time) < before_ms)
    if since is not None:
        df = df.where(F.col(time) >= S.millis_of_date(F.lit(since)))
    return df


def recent(history: DataFrame, limit: int = 50, **filters) -> DataFrame:
    return scoped(history, **filters).select(*ENTRY).orderBy(F.desc("timestamp_ms"), F.desc("id")).limit(max(1, limit))


def session_thread(history: DataFrame, session_id: str, source: str | None = None) -> DataFrame:
    return scoped(history, source).where(F.col("session_id") == session_id).select(*ENTRY).orderBy("timestamp_ms", "id")


def entry(history: DataFrame, entry_id: int) -> DataFrame:
    return history.where(F.col("id") == entry_id)


def after_cursor(rows: DataFrame, cursor: int, limit: int, key: str = "id") -> DataFrame:
    """The next rows of a table after a cursor, in order of their key: both the filter and the limit reach the scan's tasks."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(max(1, limit))


def known_entry(history: DataFrame, entry_id: int) -> DataFrame:
    """The entry, or an error if there is none."""
    found = entry(history, entry_id).limit(1)
    if found.isEmpty():
        raise KeyError(f"No entry with id {entry_id}")
    return found


def show(history: DataFrame, entry_id: int, tagged: DataFrame | None = None) -> DataFrame:
    """An entry with the size of its session, the command that resumes it, and its session's tags.

    The entry is one row: only its own session's rows are counted.
    """
    one = entry(history, entry_id).select(*ENTRY)
    session = one.where(F.coalesce("session_id", F.lit("")) != "").select("source", "session_id").distinct()
    size = history.join(F.broadcast(session), ["source", "session_id"], "left_semi").groupBy("source", "session_id").agg(F.count("*").alias("session_size"))
    out = one.join(size, ["source", "session_id"], "left").withColumn("resume", S.resume_command(F.col("source"), F.col("session_id"), F.col("project")))
    if tagged is not None:
        names = tagged.join(F.broadcast(session), ["source", "session_id"], "left_semi").groupBy("source", "session_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
        out = out.join(names, ["source", "session_id"], "left")
    return out.select(*ENTRY, "session_size", "resume", *(["tags"] if tagged is not None else []))


Query = str | list[str] | Callable[[fts.Fields], Column]


def _matching(df: DataFrame, query: Query, *columns: str) -> DataFrame:
    """Rows that match: all of a list of terms (or of a text's words), or a condition built from the columns; no terms match all."""
    found = fts.fields(df, *columns)
    if callable(query):
        return df.where(query(found))
    terms = query.split() if isinstance(query, str) else list(query)
    return df.where(found.all_of(terms)) if any(t.strip() for t in terms) else df


def search(history: DataFrame, query: Query, limit: int = 20, **filters) -> DataFrame:
    """Prompts that match a full-text query, the newest first; without terms the newest of all."""
    return recent(_matching(scoped(history, **filters), query, "prompt", "project"), limit)


UNIFIED = ("id", "source", "session_id", "project", "text", "timestamp_ms", "role", "kind", "match_source")


def search_all(history: DataFrame, events: DataFrame, query: Query, limit: int = 20, role: str = "all", **filters) -> DataFrame:
    """Prompts and session events in one list; role is all, user or assistant (which leaves prompts out)."""
    if role not in ("all", "user", "assistant"):
        raise ValueError(f"unknown role {role!r}")
    k = max(1, limit)
    found = scoped(events.withColumnRenamed("ts_ms", "timestamp_ms"), **filters)
    if role != "all":
        found = found.where(F.col("role") == role)
    found = _matching(found, query, "text", "role", "project")
    newest = [F.desc("timestamp_ms"), F.desc("id")]
    found = found.select("id", "source", "session_id", "project", F.coalesce("text", F.lit("")).alias("text"), "timestamp_ms", "role", "kind", F.lit("session_event").alias("match_source")).orderBy(*newest).limit(k)
    if role != "assistant":
        prompts = search(history, query, k, **filters)
        prompts = prompts.select("id", "source", "session_id", "project", F.col("prompt").alias("text"), "timestamp_ms", F.lit("user").alias("role"), F.lit("prompt").alias("kind"), F.lit("history").alias("match_source"))
        found = prompts.unionByName(found)
    return found.select(*UNIFIED).orderBy(*newest, "match_source").limit(k)


def search_substring(history: DataFrame, query: str, limit: int = 20, **filters) -> DataFrame:
    """Prompts or projects that hold the query as it is, A-Z like a-z."""
    hit = S.contains_ascii(F.col("prompt"), query) | S.contains_ascii(F.coalesce("project", F.lit("")), query)
    return recent(scoped(history, **filters).where(hit), limit)


def search_trajectories(trajectories: DataFrame, query: str, limit: int = 20, scope: str | None = None) -> DataFrame:
    if not query.strip():
        return trajectories.limit(0)
    hit: Column = F.lit(False)
    for c in ("search_text", "task_title", "task_description", "persona_id", "project_id"):
        hit = hit | S.contains_ascii(F.coalesce(c, F.lit("")), query)
    rows = trajectories.where(hit)
    if scope:
        rows = rows.where(F.coalesce(S.within(F.col("project_id"), scope), F.lit(False)) | F.coalesce(S.within(F.col("path"), scope), F.lit(False)))
    return rows.orderBy(F.desc("timestamp_ms"), "id").limit(max(1, limit))


def why_for_task(trajectories: DataFrame, task: str, scope: str | None = None) -> DataFrame:
    return search_trajectories(trajectories, task, 1, scope)


def in_time_window(history: DataFrame, centre_ms: int, minutes: int, **filters) -> DataFrame:
    span = minutes * 60_000
    return scoped(history, **filters).where(F.col("timestamp_ms").between(centre_ms - span, centre_ms + span)).select(*ENTRY).orderBy("timestamp_ms", "id")


def context(history: DataFrame, entry_id: int, minutes: int = 30) -> DataFrame:
    """Around an entry: its session's prompts, and other sessions' prompts within the minutes (relation says which).

    The entry is read first, so that both parts are plain filters, which reach the scan. An entry that isn't there has
    nothing around it; known_entry makes that an error.
    """
    centre = entry(history, entry_id).select("session_id", "timestamp_ms").first()
    if centre is None:
        return history.limit(0).select(*ENTRY, F.lit("nearby").alias("relation"))
    span, at = minutes * 60_000, F.col("timestamp_ms")
    same = F.lit(False) if centre.session_id is None else F.coalesce(F.col("session_id") == centre.session_id, F.lit(False))
    near = at.between(centre.timestamp_ms - span, centre.timestamp_ms + span)
    out = history.where(near & ~same).select(*ENTRY, F.lit("nearby").alias("relation"))
    if centre.session_id is not None:
        out = out.unionByName(history.where(F.col("session_id") == centre.session_id).select(*ENTRY, F.lit("session").alias("relation")))
    return out.orderBy("relation", "timestamp_ms", "id")


#: Candidate pairs that one group of context_pairs looks at, about.
PAIRS = 1 << 20


def context_pairs(history: DataFrame, minutes: int = 5, pairs: int = PAIRS) -> DataFrame:
    """All pairs of prompts of different sessions within the minutes: a band join over slots of time.

    Slots are as long as the minutes, so a slot's prompts meet those of three slots, of which about two thirds are near enough. A
    slot that has many prompts around it, as in a busy hour, is dealt out: each side is cut in as many pieces, and pieces
    meet all of the other side's. Pairs are as many as are asked for.
    """
    span = minutes * 60_000
    slot = F.expr(f"timestamp_ms div {max(1, span)}").alias("slot")
    rows = written(history.select("id", "session_id", "timestamp_ms", slot).where("timestamp_ms is not null"), "context-slots")
    own = F.coalesce(F.sum(F.when(F.col("step") == 0, F.col("n"))), F.lit(0))
    steps = F.explode(F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))).alias("step")
    counts = rows.groupBy("slot").agg(F.count("*").alias("n")).select("n", "slot", steps).groupBy((F.col("slot") + F.col("step")).alias("slot"))
    # A slot is dealt out only if it and its neighbours have sqrt(pairs) prompts at least: a row of these for many prompts.
    busy = counts.agg(F.ceil(F.sqrt(own * F.sum("n") / F.lit(float(pairs)))).cast("int").alias("pieces")).where("pieces > 1")
    hash_of, pieces = F.xxhash64("id", "timestamp_ms"), F.coalesce("pieces", F.lit(1))

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        found = side.join(F.broadcast(busy), "slot", "left")
        return found.withColumn(mine, F.pmod(hash_of, pieces).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), pieces - 1)))

    left = dealt(rows, "piece", "other_piece").select("slot", "piece", "other_piece", F.col("id").alias("a"), F.col("session_id").alias("sa"), F.col("timestamp_ms").alias("ta"))
    near = rows.select("id", "session_id", "timestamp_ms", F.col("slot").alias("at"), steps).withColumn("slot", F.col("at") + F.col("step"))
    right = dealt(near, "other_piece", "piece").select("slot", "piece", "other_piece", F.col("id").alias("b"), F.col("session_id").alias("sb"), F.col("timestamp_ms").alias("tb"))
    apart = F.col("sb").isNull() | F.col("sa").isNull() | (F.col("sa") != F.col("sb"))
    return left.join(right, ["slot", "piece", "other_piece"]).where((F.col("a") != F.col("b")) & apart & (F.abs(F.col("ta") - F.col("tb")) <= span)).select("a", "b", (F.col("tb") - F.col("ta")).alias("gap_ms"))


def resume(history: DataFrame, query: Query) -> DataFrame:
    """The newest match, if it has a session, with the command that resumes it."""
    top = search(history, query, 1)
    return top.where(F.coalesce("session_id", F.lit("")) != "").withColumn("command", S.resume_command(F.col("source"), F.col("session_id"), F.col("project")))


def pack(history: DataFrame, query: Query, limit: int = 10, tokens: int = 300, **filters) -> DataFrame:
    """Numbered evidence: the newest matches cut to a budget of tokens, with their resume commands."""
    from pyspark.sql import Window

    rows = search(history, query, limit, **filters)
    rank = F.row_number().over(Window.orderBy(F.desc("timestamp_ms"), F.desc("id")))  # over `limit` rows
    return rows.select(rank.alias("n"), "id", "source", "session_id", S.iso_time(F.col("timestamp_ms")).alias("at"), S.packed(F.col("prompt"), tokens).alias("text"), S.resume_command(F.col("source"), F.col("session_id"), F.col("project")).alias("resume"))
