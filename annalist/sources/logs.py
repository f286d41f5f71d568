"""Readers of the tools' own files as DataFrames in the store's shapes. seq orders rows by file, line and block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators.convergence import _array, _get, _kind_of, _string
from annalist.operators.search import scoped
from annalist.sources.growing import first_lines

MOST_ANSWER = 4096


def _text(v: Column, path: str) -> Column:
    """A string at a path as it stands; null if it is of another type."""
    return F.when(_kind_of(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _json(v: Column) -> Column:
    return F.to_json(v)


def json_lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """path, modified, line (from 0), value, v: every line of every file below a folder, or of files; v is null for bad JSON.

    Files are read whole, since Spark's lines have no numbers; histories are many files of moderate size.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    rows = rows.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.col("value") != "")
    return rows.withColumn("v", F.try_parse_json("value"))


def bad_lines(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count_if(F.col("v").isNull()).alias("bad"), F.count("*").alias("lines"))


def _history(source: str, session: Column, project: Column, prompt: Column, at: Column, seq: list[str], branch: Column | None = None) -> list[Column]:
    return [
        F.lit(source).alias("source"), session.alias("session_id"), project.alias("project"), prompt.alias("prompt"), S.prompt_hash(prompt).alias("prompt_hash"),
        F.coalesce(at, F.lit(0)).cast("long").alias("timestamp_ms"), (F.lit(None).cast("string") if branch is None else branch).alias("git_branch"), F.struct(*seq).alias("seq"),
    ]


def claude_prompts(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    kind = _kind_of(_get(v, "timestamp"))
    at = F.when(F.startswith(kind, F.lit("BIGINT")), F.try_variant_get(v, "$.timestamp", "long"))
    prompt = _string(v, "display")
    return lines.where(prompt.isNotNull()).select(*_history("claude", _text(v, "$.sessionId"), _text(v, "$.project"), prompt, at, ["path", "line"]))


def codex_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, cwd, git_branch from the first line of each rollout file; both id and folder are needed."""
    first = first_lines(spark, path, "rollout-*.jsonl").select("path", F.try_parse_json("value").alias("v"))
    v = F.col("v")
    rows = first.where(_text(v, "$.type") == "session_meta").select("path", _text(v, "$.payload.id").alias("session_id"), _text(v, "$.payload.cwd").alias("cwd"), _text(v, "$.payload.git.branch").alias("git_branch"))
    rows = rows.where("session_id is not null and cwd is not null")
    return rows.groupBy("session_id").agg(F.max_by("cwd", "path").alias("cwd"), F.max_by("git_branch", "path").alias("git_branch"))


def codex_prompts(lines: DataFrame, rollouts: DataFrame | None = None) -> DataFrame:
    v = F.col("v")
    at = (F.try_variant_get(v, "$.ts", "double") * 1000).cast("long")
    out = lines.where(_string(v, "text").isNotNull()).select(*_history("codex", F.coalesce(_text(v, "$.session_id"), _text(v, "$.sessionId")), F.lit(None).cast("string"), _string(v, "text"), at, ["path", "line"]))
    if rollouts is None:
        return out
    known = rollouts.select("session_id", F.col("cwd").alias("_cwd"))
    return out.join(known, "session_id", "left").withColumn("project", F.coalesce("project", "_cwd")).select(*out.columns)


def _moment(v: Column) -> Column:
    return F.coalesce(S.millis_of_iso(_text(v, "$.timestamp")), F.when(F.startswith(_kind_of(_get(v, "timestamp")), F.lit("BIGINT")), F.try_variant_get(v, "$.timestamp", "long")))


def claude_sessions(lines: DataFrame) -> DataFrame:
    """A session per transcript: first id and folder, last branch, first and last time, last answer cut."""
    v, at = F.col("v"), F.col("line")
    parts = F.transform(F.filter(_array(v, "message.content"), lambda b: _text(b, "$.type") == "text"), lambda b: _text(b, "$.text"))
    parts = F.filter(parts, lambda x: x.isNotNull())
    answer = F.when(_text(v, "$.type") == "assistant", F.coalesce(_text(v, "$.message.content"), F.when(F.size(parts) > 0, F.array_join(parts, "\n"))))
    rows = lines.where("v is not null").select(
        "path", "line", _text(v, "$.sessionId").alias("sid"), _text(v, "$.cwd").alias("cwd"), _text(v, "$.gitBranch").alias("branch"), _moment(v).alias("ms"), F.substring(answer, 1, MOST_ANSWER).alias("answer")
    )

    def there(c):
        return F.when(F.col(c).isNotNull(), at)

    out = rows.groupBy("path").agg(
        F.min_by("sid", there("sid")).alias("session_id"), F.min_by("cwd", there("cwd")).alias("cwd"), F.max_by("branch", there("branch")).alias("git_branch"),
        F.min_by("ms", there("ms")).alias("first"), F.max_by("ms", there("ms")).alias("last"), F.max_by("answer", there("answer")).alias("last_assistant_text"),
    )
    first = F.coalesce("first", F.lit(0))
    return out.where("session_id is not null").select(
        "session_id", F.lit("claude").alias("source"), "cwd", "git_branch", first.cast("long").alias("first_activity_ms"), F.coalesce("last", first).cast("long").alias("last_activity_ms"),
        "last_assistant_text", F.col("path").alias("raw_path"), F.lit(1).alias("parser_version"), F.struct("path").alias("seq"),
    )


def claude_blocks(lines: DataFrame) -> DataFrame:
    """The content blocks of a transcript's messages; a content that is a string is one text block."""
    v = F.col("v")
    metas = claude_sessions(lines).select(F.col("raw_path").alias("path"), "session_id", F.col("cwd").alias("cwd"), "git_branch")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    uid = F.coalesce(_text(v, "$.uuid"), _text(v, "$.message.id"), F.concat(stem, F.lit(":"), F.col("line").cast("string")))
    usage = _get(v, "message.usage")
    whole = _text(v, "$.message.content")
    blocks = F.when(S.non_empty(whole).isNotNull(), F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), whole.alias("text")))))).otherwise(_array(v, "message.content"))
    rows = lines.where("v is not null").select(
        "path", "line", uid.alias("message_id"), _text(v, "$.parentUuid").alias("parent_id"), F.coalesce(_moment(v), F.lit(0)).cast("long").alias("ts_ms"),
        F.coalesce(_text(v, "$.message.role"), _text(v, "$.type"), F.lit("")).alias("speaker"), _text(v, "$.message.model").alias("model"), F.when(usage.isNotNull(), F.to_json(usage)).alias("token_json"),
        F.posexplode(blocks).alias("block", "b"),
    )
    return rows.join(metas, "path").withColumn("type", F.coalesce(_text(F.col("b"), "$.type"), F.lit(""))).withColumn("seq", F.struct("path", "line", "block"))


def _call(b: Column) -> tuple[Column, Column, Column, Column]:
    args = F.coalesce(F.to_json(_get(b, "input")), F.lit("null"))
    name = F.coalesce(_text(b, "$.name"), F.lit(""))
    return F.coalesce(_text(b, "$.id"), F.lit("")), name, args, S.tool_target(name, args)


def claude_events(blocks: DataFrame) -> DataFrame:
    b, kind = F.col("b"), F.col("type")
    _, name, args, target = _call(b)
    content = _get(b, "content")
    result = F.when(_kind_of(content) == "STRING", F.when(S.non_empty(_text(b, "$.content")).isNotNull(), _text(b, "$.content"))).when(content.isNotNull() & (_kind_of(content) != "VOID"), F.to_json(content))
    speaker = F.when(F.col("speaker") == "assistant", "assistant").otherwise("user")
    text = F.when(kind == "text", _text(b, "$.text")).when(kind == "thinking", F.coalesce(_text(b, "$.thinking"), _text(b, "$.text"))).when(kind == "tool_use", S.tool_text(name, target, args)).when(kind == "tool_result", result)
    rows = blocks.where(kind.isin("text", "thinking", "tool_use", "tool_result")).withColumn("out", text).where(~kind.isin("text", "thinking") | S.non_empty(F.col("out")).isNotNull())
    role = F.when(kind == "text", speaker).when(kind == "tool_result", "tool_result").otherwise("assistant")
    return rows.select(
        F.lit("claude").alias("source"), "session_id", F.col("cwd").alias("project"), "cwd", "git_branch", "message_id", "parent_id", "ts_ms", role.alias("role"), kind.alias("kind"),
        F.col("out").alias("text"), "model", "token_json", F.concat("message_id", F.lit(":"), F.col("block").cast("string")).alias("event_uid"), "seq",
    )


def claude_tool_calls(blocks: DataFrame) -> DataFrame:
    tool, name, args, target = _call(F.col("b"))
    rows = blocks.where(F.col("type") == "tool_use").where((tool != "") & (name != ""))
    return rows.select(F.lit("claude").alias("source"), "session_id", "message_id", tool.alias("tool_use_id"), name.alias("name"), target.alias("target"), args.alias("args_json"), F.lit(None).cast("int").alias("is_error"), "ts_ms", "git_branch", "cwd", "seq")


#: Levels of arrays and objects that are followed inside a patch.
PATCH_DEPTH = 12
#: Where a patch's text may stand in an object, in this order.
PATCH_KEYS = ("patch", "diff", "text", "content", "structuredPatch")


def lines_changed(patch: Column, depth: int = PATCH_DEPTH) -> Column:
    """struct(added, removed) of a patch: of a text its lines, of an array the sum of its entries, of an object the first
    of PATCH_KEYS that counts anything. One expression: nothing is exploded or shuffled, and the patch is computed once."""
    return S.bound(patch, lambda p: _lines_changed(p, depth))


def _lines_changed(patch: Column, depth: int) -> Column:
    kind, nothing = _kind_of(patch), S.patch_counts(F.lit(""))
    own = F.when(kind == "STRING", S.patch_counts(F.try_variant_get(patch, "$", "string")))
    if depth == 0:
        return F.coalesce(own, nothing)
    is_array = F.startswith(kind, F.lit("ARRAY"))
    inside = F.when(is_array, F.try_variant_get(patch, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), F.filter(F.array(*(_get(patch, k) for k in PATCH_KEYS)), lambda x: x.isNotNull()))

    def of(children):
        total = F.aggregate(children, nothing, lambda s, c: F.struct((s["added"] + c["added"]).alias("added"), (s["removed"] + c["removed"]).alias("removed")))
        return F.when(is_array, total).otherwise(F.get(F.filter(children, lambda c: c["added"] + c["removed"] > 0), F.lit(0)))

    counted = S.bound(F.transform(inside, lambda x: _lines_changed(x, depth - 1)), of)
    return F.coalesce(own, counted, nothing)


def claude_results(blocks: DataFrame) -> DataFrame:
    """What tool results say of their calls: is_error, and the edit where there is one."""
    b = F.col("b")
    tool = F.coalesce(_text(b, "$.tool_use_id"), _text(b, "$.toolUseId"), F.lit(""))
    result = F.coalesce(*(_get(b, k) for k in ("toolUseResult", "tool_use_result", "content.toolUseResult", "content.tool_use_result")))
    patch = _get(result, "structuredPatch")
    counts = lines_changed(F.coalesce(patch, result))
    flag = F.when(_kind_of(_get(result, "userModified")) == "BOOLEAN", F.try_variant_get(result, "$.userModified", "boolean").cast("int"))
    error = F.when(_kind_of(_get(b, "is_error")) == "BOOLEAN", F.try_variant_get(b, "$.is_error", "boolean").cast("int"))
    rows = blocks.where(F.col("type") == "tool_result").where(tool != "")
    return rows.select(
        F.lit("claude").alias("source"), "session_id", "message_id", tool.alias("tool_use_id"), error.alias("is_error"), result.isNotNull().alias("is_edit"), F.coalesce(_text(result, "$.filePath"), _text(result, "$.file_path")).alias("file_path"),
        counts["added"].alias("lines_added"), counts["removed"].alias("lines_removed"), F.when(patch.isNotNull(), F.to_json(patch)).alias("structured_patch_json"), flag.alias("user_modified"), "ts_ms", "git_branch", "cwd", "seq",
    )


def claude_edit_calls(calls: DataFrame) -> DataFrame:
    return calls.where(S.is_edit_tool(F.col("name")) & F.col("target").isNotNull()).select("source", "session_id", "message_id", "tool_use_id", F.col("target").alias("file_path"), F.col("name").alias("tool_name"), "ts_ms", "git_branch", "cwd", "seq")


def cursor_prompts(lines: DataFrame) -> DataFrame:
    """User lines of agent transcripts; session and project come from the path, the time is the file's."""
    v = F.col("v")
    texts = F.filter(_array(v, "message.content"), lambda b: _text(b, "$.type") == "text")
    prompt = S.without_query_tag(F.coalesce(_text(v, "$.message.content"), _text(F.get(texts, F.lit(0)), "$.text"), F.lit("")))
    session = F.regexp_extract("path", r"agent-transcripts/([^/]+)/", 1)
    project = S.cursor_project(F.regexp_extract("path", r"([^/]+)/agent-transcripts/", 1))
    rows = lines.where((_text(v, "$.role") == "user") & (prompt != ""))
    return rows.select(*_history("cursor", session, project, prompt, F.unix_millis("modified"), ["path", "line"]))


def grok_text(content: Column) -> Column:
    """A string, the texts of an array joined by lines, or an object's text."""
    one = F.when(_kind_of(content) == "STRING", S.non_empty(F.try_variant_get(content, "$", "string"))).when(F.startswith(_kind_of(content), F.lit("OBJECT")), _string(content, "text"))
    many = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda x: F.coalesce(F.when(_kind_of(x) == "STRING", S.non_empty(F.try_variant_get(x, "$", "string"))), _string(x, "text"))), lambda x: x.isNotNull())
    return F.when(F.startswith(_kind_of(content), F.lit("ARRAY")), F.nullif(F.array_join(many, "\n"), F.lit(""))).otherwise(one)


def grok_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(prompts, sessions): chat histories beside their summary.json; a prompt's time is the start plus its number."""
    notes = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="summary.json").select(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "").alias("folder"), F.try_parse_json("value").alias("s"))
    return grok_rows(json_lines(spark, path, "chat_history*.jsonl"), notes)


def grok_rows(lines: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of lines (path, line, v) and summaries (folder, s)."""
    v, s = F.col("v"), F.col("s")
    folder = F.regexp_replace("path", r"/[^/]*$", "")

    def moment(key):
        return F.coalesce(S.millis_of_iso(_text(s, f"$.{key}")), F.when(F.startswith(_kind_of(_get(s, key)), F.lit("BIGINT")), F.try_variant_get(s, f"$.{key}", "long")))

    notes = notes.select("folder", _text(s, "$.info.id").alias("session_id"), _text(s, "$.info.cwd").alias("cwd"), _text(s, "$.head_branch").alias("git_branch"), F.coalesce(moment("created_at"), F.lit(0)).alias("first"), moment("updated_at").alias("last"))
    lines = lines.withColumn("folder", folder).withColumn("said", grok_text(_get(v, "content"))).where("said is not null")
    mine = lines.where((_text(v, "$.type") == "user") & _get(v, "synthetic_reason").isNull())
    mine = mine.groupBy("folder", "path").agg(F.array_sort(F.collect_list(F.struct("line", "said"))).alias("all")).select("folder", "path", F.posexplode("all").alias("n", "x"))
    prompts = mine.join(notes, "folder").where("session_id is not null").withColumn("line", F.col("n"))
    prompts = prompts.select(*_history("grok", F.col("session_id"), F.col("cwd"), F.col("x.said"), F.col("first") + F.col("n"), ["path", "line"]))
    last = lines.where(_text(v, "$.type") == "assistant").groupBy("folder").agg(F.max_by("said", F.struct("path", "line")).alias("answer"))
    sessions = notes.where("session_id is not null").join(last, "folder", "left").select(
        "session_id", F.lit("grok").alias("source"), "cwd", "git_branch", F.col("first").alias("first_activity_ms"), F.coalesce("last", "first").alias("last_activity_ms"),
        F.substring("answer", 1, MOST_ANSWER).alias("last_assistant_text"), F.col("folder").alias("raw_path"), F.lit(1).alias("parser_version"), F.struct("folder").alias("seq"),
    )
    return prompts, sessions


def _texts(v: Column, *keys: str) -> Column:
    return F.array(*(_text(v, f"$.{k}") for k in keys))


def _items(v: Column, key: str) -> Column:
    return F.transform(_array(v, key), lambda x: F.when(_kind_of(x) == "STRING", F.try_variant_get(x, "$", "string")))


def trajectory_text(v: Column) -> Column:
    """All that a trajectory can be found by, one part a line."""
    choices = F.flatten(F.transform(F.filter(_array(v, "decisions"), lambda d: F.startswith(_kind_of(d), F.lit("OBJECT"))), lambda d: F.concat(_texts(d, "question", "chosen", "reasoning"), _items(d, "alternatives"))))
    sure = _get(v, "retrospective.confidence")
    run = F.concat(
        _texts(v, "id", "personaId", "projectId", "status", "task.title", "task.description"), choices, _texts(v, "retrospective.summary", "retrospective.approach"),
        F.array(F.when(sure.isNotNull(), F.to_json(sure))), _items(v, "retrospective.learnings"),
    )
    values = [F.flatten(F.transform(_array(v, k), lambda o: F.map_values(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(F.try_variant_get(o, "$", "map<string,string>"), F.create_map().cast("map<string,string>")))))))) for k in ("lessons", "conventions")]
    roll = F.concat(_texts(v, "narrative"), _items(v, "keyFindings"), _items(v, "keyLearnings"), _items(v, "openQuestions"), *values)
    parts = F.when(_text(v, "$.type") == "compacted", F.concat(run, roll)).otherwise(run)
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def trajectories(spark: SparkSession, path: str, roll_ups: bool = True) -> DataFrame:
    """Trajectory files below a folder; indexes, state and traces are left out, files without an id are none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    files = files.select(F.col("_metadata.file_path").alias("path"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("updated_ms"), F.try_parse_json("value").alias("v"))
    return trajectory_rows(files.where(~F.col("path").rlike(r"/(index|\.sync-state)\.json$|\.trace\.json$")), roll_ups)


def trajectory_rows(files: DataFrame, roll_ups: bool = True) -> DataFrame:
    """Rows of trajectories of documents (path, updated_ms, v)."""
    v = F.col("v")
    rolled = F.coalesce((_text(v, "$.type") == "compacted") & F.startswith(_kind_of(_get(v, "sourceTrajectories")), F.lit("ARRAY")), F.lit(False))
    times = [F.when(S.millis_of_iso(_text(v, f"$.{k}")) > 0, S.millis_of_iso(_text(v, f"$.{k}"))) for k in ("completedAt", "startedAt", "compactedAt")]
    chosen = F.filter(_array(v, "decisions"), lambda d: F.startswith(_kind_of(d), F.lit("OBJECT")))
    rows = files.where(F.coalesce(_text(v, "$.id"), F.lit("")) != "")
    rows = rows if roll_ups else rows.where(~rolled)
    return rows.select(
        _text(v, "$.id").alias("id"), F.when(F.startswith(_kind_of(_get(v, "version")), F.lit("BIGINT")), F.try_variant_get(v, "$.version", "long")).alias("version"), _text(v, "$.personaId").alias("persona_id"),
        _text(v, "$.projectId").alias("project_id"), _text(v, "$.task.title").alias("task_title"), _text(v, "$.task.description").alias("task_description"), _text(v, "$.status").alias("status"),
        _text(v, "$.startedAt").alias("started_at"), _text(v, "$.completedAt").alias("completed_at"), F.concat(F.lit("["), F.array_join(F.transform(chosen, lambda x: F.to_json(x)), ","), F.lit("]")).alias("decisions_json"),
        F.when(rolled, F.to_json(v)).otherwise(F.coalesce(F.when(F.startswith(_kind_of(_get(v, "retrospective")), F.lit("OBJECT")), F.to_json(_get(v, "retrospective"))), F.lit("{}"))).alias("retrospective_json"),
        trajectory_text(v).alias("search_text"), "path", "updated_ms", F.coalesce(*times, "updated_ms").alias("timestamp_ms"), F.struct("path").alias("seq"),
    )


def opencode_prompts(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """User texts of an OpenCode database: parts with their messages and sessions."""
    rows = (
        part.select(F.col("id").alias("part_id"), "message_id", F.col("data").alias("p"), F.col("time_created").alias("pt"))
        .join(message.select(F.col("id").alias("message_id"), F.col("session_id"), F.col("data").alias("m"), F.col("time_created").alias("mt")), "message_id")
        .join(session.select(F.col("id").alias("session_id"), "directory", F.col("time_created").alias("st")), "session_id")
        .where((F.get_json_object("m", "$.role") == "user") & (F.get_json_object("p", "$.type") == "text"))
        .withColumn("said", S.non_empty(F.get_json_object("p", "$.text")))
        .where("said is not null")
    )
    return rows.select(*_history("opencode", F.col("session_id"), F.col("directory"), F.col("said"), F.coalesce("pt", "mt", "st"), ["pt", "part_id"]))


def relay_messages(pages: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Messages of chat pages (channel, value: a page's JSON): `[sender] text`, in their thread or channel.

    after: channel, after: the greatest message id that was read before; only later ones are taken.
    """
    v = F.try_parse_json("value")
    rows = pages.withColumn("v", v).select("channel", F.posexplode(_array(F.col("v"), "data")).alias("n", "m"))
    m = F.col("m")
    said = _string(m, "text")
    sender = F.coalesce(_string(m, "from_name"), _string(m, "from_id"), F.lit(""))
    rows = rows.where(said.isNotNull()).withColumn("mid", _text(m, "$.id"))
    if after is not None:
        rows = rows.join(after.select("channel", "after"), "channel", "left").where(F.col("after").isNull() | (F.col("mid") > F.col("after")))
    return rows.select(*_history("relay", F.coalesce(_string(m, "thread_id"), F.col("channel")), F.lit(None).cast("string"), F.concat(F.lit("["), sender, F.lit("] "), said), S.millis_of_iso(_text(m, "$.created_at")), ["channel", "mid"]))


def relay_cursors(pages: DataFrame) -> DataFrame:
    """channel, after: the greatest message id, as a string."""
    ids = pages.select("channel", F.explode(_array(F.try_parse_json("value"), "data")).alias("m"))
    return ids.groupBy("channel").agg(F.max(_text(F.col("m"), "$.id")).alias("after"))


EXPORT = ("source", "session_id", "project", "prompt", "prompt_hash", "timestamp_ms")


def exported(history: DataFrame, **filters) -> DataFrame:
    """Lines of JSON in order of time; the hash is computed anew. filters: source, project, since, before_ms."""
    rows = scoped(history, **filters).withColumn("prompt_hash", S.prompt_hash(F.col("prompt"))).orderBy("timestamp_ms", "id")
    return rows.select(F.to_json(F.struct(*EXPORT), {"ignoreNullFields": "false"}).alias("value"))


def write_export(history: DataFrame, folder: str, gz: bool = False, **filters) -> None:
    """Exported lines as text files in order (part numbers follow the time); no match is an error."""
    lines = exported(history, **filters)
    if lines.isEmpty():
        raise ValueError("No entries matched the export filters.")
    lines.write.option("compression", "gzip" if gz else "none").text(folder)


def import_preview(rows: DataFrame, k: int = 5) -> tuple[int, DataFrame]:
    """A dry run: the number of rows, and the first k as minute, source, project and the prompt cut to 80 characters."""
    order = [c for c in ("timestamp_ms", "source", "prompt") if c in rows.columns]
    return rows.count(), rows.orderBy(*order).limit(k).select(S.minute(F.col("timestamp_ms")).alias("at"), "source", "project", F.replace(F.substring("prompt", 1, 80), F.lit("\n"), F.lit(" ")).alias("prompt"))


def import_into(store, rows: DataFrame) -> dict[str, int]:
    """Adds imported rows; tells how many were new and how many the store had already."""
    ordered = rows.withColumns({"git_branch": F.lit(None).cast("string"), "seq": F.struct("timestamp_ms", "source", "prompt")})
    total = rows.count()
    added = store.add_history(ordered)
    return {"inserted": added, "skipped": total - added}


def imported(lines: DataFrame) -> DataFrame:
    """Rows of exported lines (value). Blank lines, bad JSON and empty prompts are skipped; a missing source or time is an error."""
    row = F.from_json("value", "source string, session_id string, project string, prompt string, prompt_hash string, timestamp_ms long")
    rows = lines.where(F.try_parse_json("value").isNotNull()).select(row.alias("r"), "value").select("r.*", "value").where(F.coalesce("prompt", F.lit("")) != "")
    needed = F.col("source").isNotNull() & F.col("timestamp_ms").isNotNull()
    rows = rows.withColumn("source", F.when(needed, F.col("source")).otherwise(F.raise_error(F.concat(F.lit("a line lacks source or timestamp_ms: "), F.substring("value", 1, 80)))))
    return rows.withColumn("prompt_hash", F.coalesce("prompt_hash", S.prompt_hash(F.col("prompt")))).select(*EXPORT)
