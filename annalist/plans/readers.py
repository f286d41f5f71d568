"""Queries that run the readers, ingestion and export over files and rows made from the driver's tables, with their SQL."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators import convergence, learn, links, sessions, store
from annalist.plans.queries import _COMMITS, NEWEST, ORACLE_SQL, QUERIES, TOKENS, _commits, _has, _on, _runs, query
from annalist.plans.views import view
from annalist.sources import growing, logs, sqlite
from annalist.streaming import ingest
from annalist.work import scratch


_STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_PROMPT = _STRIPPED.format("prompt")
_READ = ("source", "session_id", "project", "prompt", "prompt_hash", "timestamp_ms")
_CLAUDE = f"select 'claude' as source, session_id, project, {_PROMPT} as prompt, substr(sha256({_PROMPT}), 1, 16) as prompt_hash, timestamp_ms from history_v where {_PROMPT} <> ''"


def _written_lines(history: DataFrame, name: str) -> str:
    path = scratch(history.sparkSession, name)
    line = F.to_json(F.struct(F.col("prompt").alias("display"), F.col("timestamp_ms").alias("timestamp"), F.col("session_id").alias("sessionId"), "project"))
    history.select(line.alias("value")).write.text(path)
    return path


_on("read_claude_prompts", _CLAUDE, lambda h: logs.claude_prompts(logs.json_lines(h.sparkSession, _written_lines(h, "claude"), "*.txt")).select(*_READ), "history_v")


def _growing(history: DataFrame) -> DataFrame:
    """The same lines by byte ranges, in two runs of which the second begins where the first ended."""
    spark, path = history.sparkSession, _written_lines(history, "growing")
    none = spark.createDataFrame([], "path string, bytes long")
    first = growing.new_lines(spark, path, none, "*.txt", most=20_000, range_bytes=6_000)
    rest = growing.new_lines(spark, path, growing.progress(first), "*.txt", range_bytes=1 << 20)
    return logs.claude_prompts(first.unionByName(rest)).select(*_READ)


_on("read_growing_lines", _CLAUDE, _growing, "history_v")
_on(
    "read_codex_prompts",
    f"select 'codex' as source, h.session_id, cwd as project, {_PROMPT} as prompt, timestamp_ms // 1000 * 1000 as timestamp_ms from history_v h left join (select session_id, min(cwd) as cwd from sessions_v group by all) s on s.session_id = h.session_id where {_PROMPT} <> ''",
    lambda h, s: logs.codex_prompts(
        h.select(F.lit("f").alias("path"), F.col("id").alias("line"), F.parse_json(F.to_json(F.struct(F.col("prompt").alias("text"), F.floor(F.col("timestamp_ms") / 1000).alias("ts"), "session_id"))).alias("v")),
        s.groupBy("session_id").agg(F.min("cwd").alias("cwd")),
    ).select("source", "session_id", "project", "prompt", "timestamp_ms"),
    "history_v", "sessions_v",
)


def _transcripts(events: DataFrame) -> DataFrame:
    """Lines of agent transcripts (path, modified, line, v): a file for each session."""
    said = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    v = F.to_json(F.struct(F.col("role").alias("type"), F.col("session_id").alias("sessionId"), F.col("project").alias("cwd"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("gitBranch"), F.col("ts_ms").alias("timestamp"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"), said.alias("message"), "role"))
    path = F.concat(F.lit("/t/my-work/agent-transcripts/"), "session_id", F.lit("/"), "session_id", F.lit(".jsonl"))
    return events.select(path.alias("path"), F.timestamp_millis(F.lit(1704067200000)).alias("modified"), F.col("id").alias("line"), F.parse_json(v).alias("v"))


_on(
    "read_claude_sessions",
    """select session_id, 'claude' as source, arg_min(project, id) filter (project is not null) as cwd, arg_max('b' || cast(id % 3 as varchar), id) as git_branch, arg_min(ts_ms, id) as first_activity_ms, arg_max(ts_ms, id) as last_activity_ms,
    substr(arg_max(text, id) filter (role = 'assistant' and text is not null), 1, 4096) as last_assistant_text from session_events_v group by session_id""",
    lambda e: logs.claude_sessions(_transcripts(e)).select("session_id", "source", "cwd", "git_branch", "first_activity_ms", "last_activity_ms", "last_assistant_text"),
    "session_events_v",
)
_on(
    "read_claude_events",
    f"select session_id, 'u' || cast(id as varchar) as message_id, 'u' || cast(id as varchar) || ':0' as event_uid, ts_ms, case when role = 'assistant' then 'assistant' else 'user' end as role, 'text' as kind, text from session_events_v where {_STRIPPED.format('text')} <> ''",
    lambda e: logs.claude_events(logs.claude_blocks(_transcripts(e))).select("session_id", "message_id", "event_uid", "ts_ms", "role", "kind", "text"),
    "session_events_v",
)
_on(
    "read_cursor_prompts",
    f"select 'cursor' as source, session_id, '/my/work' as project, {_STRIPPED.format('text')} as prompt, cast(1704067200000 as bigint) as timestamp_ms from session_events_v where role = 'user' and {_STRIPPED.format('text')} <> ''",
    lambda e: logs.cursor_prompts(_transcripts(e)).select("source", "session_id", "project", "prompt", "timestamp_ms"),
    "session_events_v",
)
_on(
    "read_opencode_prompts",
    f"select 'opencode' as source, session_id, '/d/' || session_id as project, {_STRIPPED.format('text')} as prompt, case when id % 2 = 0 then ts_ms else ts_ms + 1 end as timestamp_ms from session_events_v where role = 'user' and {_STRIPPED.format('text')} <> ''",
    lambda e: logs.opencode_prompts(
        e.select(F.col("session_id").alias("id"), F.concat(F.lit("/d/"), "session_id").alias("directory"), F.lit(0).cast("long").alias("time_created")).distinct(),
        e.select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), "session_id", (F.col("ts_ms") + 1).alias("time_created"), F.to_json(F.struct("role")).alias("data")),
        e.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), "session_id", F.when(F.col("id") % 2 == 0, F.col("ts_ms")).alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data")),
    ).select("source", "session_id", "project", "prompt", "timestamp_ms"),
    "session_events_v",
)
_on(
    "read_relay_messages",
    f"select 'relay' as source, session_id, '[' || role || '] ' || {_STRIPPED.format('text')} as prompt, ts_ms as timestamp_ms from session_events_v where {_STRIPPED.format('text')} <> ''",
    lambda e: logs.relay_messages(e.groupBy(F.col("session_id").alias("channel")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("role").alias("from_name"), "text", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"))).alias("data"))).alias("value"))).select("source", "session_id", "prompt", "timestamp_ms"),
    "session_events_v",
)
_on(
    "export_and_import",
    "select source, session_id, project, prompt, substr(sha256(prompt), 1, 16) as prompt_hash, timestamp_ms from history_v where source = 'claude' and prompt <> ''",
    lambda h: logs.imported(logs.exported(h, source="claude")),
    "history_v",
)
_on(
    "stats_scoped",
    "with s as (select * from history_v where project = '/work/p2' or starts_with(lower(project), '/work/p2/')) select count(*) as total, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms, count(distinct source) as sources, (select count(*) from s group by project order by 1 desc limit 1) as largest from s",
    lambda h: sessions.stats(h, scope="/work/p2").select("total", "first_ms", "last_ms", F.size("by_source").cast("long").alias("sources"), F.get("by_project", F.lit(0))["n"].alias("largest")),
    "history_v",
)


@query(f"""with c as ({_COMMITS}), p as (select *, last_activity_ms as at_ms, coalesce(cwd = repo or starts_with(cwd, repo || '/'), false) as cm, coalesce(git_branch = branch, false) as bm, greatest(first_activity_ms - commit_ms, commit_ms - last_activity_ms, 0) as d from c join sessions_v s on s.last_activity_ms between commit_ms - 129600000 and commit_ms + 21600000),
s as (select *, round(least(0.98, 0.45 + case when cm then 0.2 else 0 end + case when bm then 0.2 else 0 end + case when d = 0 then 0.1 when d <= 7200000 then 0.05 else 0 end), 6) as confidence from p where cm or bm)
select commit_sha, source, session_id, repo, branch, cast(confidence as double) as confidence, 'time' as match_method, '["f' || cast(commit_sha as varchar) || '"]' as files_json, cm as cwd_match, bm as branch_match, d as distance from s qualify row_number() over (partition by commit_sha order by confidence desc, at_ms desc, source desc, session_id desc) = 1""")
def commit_link_rows(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    changes = commits.select("commit_sha", F.concat(F.lit("f"), F.col("commit_sha").cast("string")).alias("file_path"), F.lit(1).cast("long").alias("lines_added"), F.lit(None).cast("long").alias("lines_removed"))
    rows = links.link_rows(links.best_candidates(view(spark, sf_dir, "sessions_v"), commits), commits, changes, "time", 5)
    told = {n: F.get_json_object("evidence_json", f"$.candidate.{k}").cast(t).alias(n) for n, k, t in (("cwd_match", "cwd_match", "boolean"), ("branch_match", "branch_match", "boolean"), ("distance", "time_distance_ms", "long"))}
    return rows.select("commit_sha", "source", "session_id", "repo", "branch", "confidence", "match_method", "files_json", *told.values())


# the store, written anew from a whole table
_ROWS = "select row_number() over (order by id) as id, source, session_id, project, prompt, timestamp_ms from document_history_v where prompt is not null"


def _store_of(history: DataFrame, times: int = 1) -> store.Store:
    """A new store to which a history was added so many times."""
    kept = store.Store(history.sparkSession, scratch(history.sparkSession, "store"))
    none = F.lit(None).cast("string")
    rows = history.where("prompt is not null").withColumns({"seq": F.struct("id"), "prompt_hash": none, "git_branch": none})
    for _ in range(times):
        kept.add_history(rows)
    return kept


_on("store_twice", _ROWS, lambda h: _store_of(h, 2).history().select("id", "source", "session_id", "project", "prompt", "timestamp_ms"), "document_history_v")


def _indexed(name: str, terms, condition: str) -> None:
    sql = f"with n as ({_ROWS}), t as (select *, {TOKENS.format(c='prompt')} as tok, {TOKENS.format(c='coalesce(project, chr(32))')} as ptok from n) select id, source, session_id, project, prompt, timestamp_ms from t where {condition} {NEWEST} limit 1000"
    _on(name, sql, lambda h: _store_of(h).search(terms, 1000), "document_history_v")


_indexed("search_store_terms", ["license", "version"], f"{_has(' license ')} and {_has(' version ')}")
_indexed("search_store_rare", lambda f: (f.has("clown") | f.has("moron")) & ~f.has("trash"), f"({_has(' clown ')} or {_has(' moron ')}) and not {_has(' trash ')}")
_indexed("search_store_prefix", lambda f: f.has("licen", prefix=True) & f.only("project").has("docs en"), f"{_has(' licen')} and {_has(' docs en ', 'ptok')}")
_RUN_ROWS = "select 't' || cast(doc_id as varchar) as t, lang as project, 's' || cast(doc_id as varchar) as prompt, 1704067200000 + doc_id as ms from documents"


@query(f"""with r as ({_RUN_ROWS}), h as (select id, source, case when source = 'trajectory' then 't' || cast(id % 100 as varchar) else session_id end as session_id, project, prompt, timestamp_ms from history_v)
select * from h where not (source = 'trajectory' and coalesce(session_id, '') in (select t from r)) union all select 5000000 + row_number() over (order by ms, t) as id, 'trajectory', t, project, prompt, ms from r""")
def mirrored_trajectories(spark, sf_dir):
    """Trajectories' own rows of the history are replaced by new ones with new ids."""
    none = F.lit(None).cast("string")
    old = F.when(F.col("source") == "trajectory", F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).otherwise(F.col("session_id"))
    history = view(spark, sf_dir, "history_v").withColumns({"session_id": old, "prompt_hash": none, "git_branch": none})
    runs = _runs(spark, sf_dir).withColumn("search_text", F.get_json_object("retrospective_json", "$.summary"))
    return store.mirrored_trajectories(history, runs, 5_000_000).select("id", "source", "session_id", "project", "prompt", "timestamp_ms")


# streams: the query runs until it has taken what is there, and its sink is read back
def _settings(spark: SparkSession, **values: str):
    """Session settings for the time of a block."""

    @contextlib.contextmanager
    def held():
        old = {k: spark.conf.get(k, None) for k in values}
        for k, v in values.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return held()


def _growing_stream(history: DataFrame) -> DataFrame:
    """The same lines as a stream over growing files, in byte ranges."""
    spark, out = history.sparkSession, scratch(history.sparkSession, "growing-stream")
    lines = growing.stream_lines(spark, _written_lines(history, "growing-in"), "*.txt", 1 << 20)
    logs.claude_prompts(lines).select(*_READ).writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out)


_on("read_growing_stream", _CLAUDE, _growing_stream, "history_v")
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _session_stream(events: DataFrame) -> DataFrame:
    """Session rows as a stream, folded with state, and the parts folded when they are read."""
    spark, folder = events.sparkSession, scratch(events.sparkSession, "session-stream")
    none = F.lit(None).cast("string")
    rows = events.select("session_id", "source", F.col("project").alias("cwd"), F.col("role").alias("git_branch"), F.when(F.col("role") == "assistant", F.col("text")).alias("last_assistant_text"), none.alias("raw_path"), F.lit(1).alias("parser_version"), F.col("ts_ms").alias("first_activity_ms"), F.col("ts_ms").alias("last_activity_ms"), F.col("id").alias("seq"))
    rows.write.parquet(f"{folder}/in")
    kept = store.Store(spark, f"{folder}/store")
    with _settings(spark, **_ROCKS):
        ingest.watch_sessions(kept, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in"), f"{folder}/checkpoint").awaitTermination()
    return ingest.streamed_sessions(kept)


QUERIES["stream_session_fold"] = lambda spark, sf_dir: _session_stream(view(spark, sf_dir, "session_events_v"))
ORACLE_SQL["stream_session_fold"] = ORACLE_SQL["session_fold"]

# nested JSON
@query(r"""with l as (select id, ts_ms, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from session_events_v)
select id, '### ' || role || ' ' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') || chr(10) || regexp_replace(case when strlen(t) > 2 then substr(t, 1, 4000) || chr(10) || 'out ' || cast(id as varchar) else 'out ' || cast(id as varchar) end, '(/users/|/home/)[^/]+', '\1~', 'gi') as transcript from l""")
def harvest_texts(spark, sf_dir):
    """Texts of raw transcript lines, eight levels down; what lies deeper or under other keys isn't taken."""
    e = view(spark, sf_dir, "session_events_v")
    deep = F.col("text")
    for _ in range(5):
        deep = F.array(deep)
    out = F.concat(F.lit("out "), F.col("id").cast("string"))
    line = F.struct(F.col("role").alias("type"), F.col("ts_ms").alias("timestamp"), F.struct(F.struct(deep.alias("content"), F.lit("no").alias("other")).alias("message"), out.alias("stdout")).alias("message"), F.lit("unseen").alias("note"))
    lines = e.select(F.col("id").cast("string").alias("path"), F.lit(0).alias("line"), F.parse_json(F.to_json(line)).alias("v"))
    return learn.raw_transcripts(lines).select(F.col("path").cast("long").alias("id"), "transcript")


@query(r"""with p as (select doc_id, string_split('+++ b' || chr(10) || regexp_replace(regexp_replace(text, '(^|\n)T', '\1+', 'g'), '(^|\n)A', '\1-', 'g'), chr(10)) as l from documents),
c as (select doc_id, len(list_filter(l, lambda x: starts_with(x, '+') and not starts_with(x, '+++'))) as a, len(list_filter(l, lambda x: starts_with(x, '-') and not starts_with(x, '---'))) as r from p)
select doc_id, 2 * a as added, 2 * r as removed from c""")
def patch_counts_nested(spark, sf_dir):
    """A patch ten levels down, twice in an array, beside keys that count nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    patch = F.concat(F.lit("+++ b\n"), F.regexp_replace(F.regexp_replace("text", r"(^|\n)T", "$1+"), r"(^|\n)A", "$1-"))
    v = F.array_repeat(patch, 2)
    for _ in range(4):
        v = F.struct(F.lit("plain").alias("diff"), F.array(v).alias("content"))
    return docs.select("doc_id", logs.lines_changed(F.parse_json(F.to_json(v))).alias("c")).select("doc_id", "c.added", "c.removed")


# folds of tool calls and file edits
_CALL = "select source, session_id, 't' || cast(id % 5 as varchar) as tool_use_id, id as seq, 'm' || cast(id as varchar) as message_id, text, ts_ms, case when id % 3 = 0 then cast(id % 2 as integer) end as flag, project, id from session_events_v"
_BY_TOOL = ("source", "session_id", "tool_use_id")


def _calls(spark, sf_dir) -> DataFrame:
    e = view(spark, sf_dir, "session_events_v")
    text = lambda c: c.cast("string")
    return e.select("source", "session_id", F.concat(F.lit("t"), text(F.col("id") % 5)).alias("tool_use_id"), F.col("id").alias("seq"), F.concat(F.lit("m"), text(F.col("id"))).alias("message_id"), "text", "ts_ms", F.when(F.col("id") % 3 == 0, (F.col("id") % 2).cast("int")).alias("flag"), "project", "id")


@query(f"with c as ({_CALL}) select source, session_id, tool_use_id, max(seq) as seq, arg_max(message_id, seq) as message_id, arg_max(coalesce(text, ''), seq) as args_json, arg_max(ts_ms, seq) as ts_ms, arg_max(flag, seq) filter (flag is not null) as is_error from c group by all")
def fold_tool_calls(spark, sf_dir):
    rows = _calls(spark, sf_dir).select(*_BY_TOOL, "seq", "message_id", F.coalesce("text", F.lit("")).alias("args_json"), "ts_ms", F.col("flag").alias("is_error"))
    return store.fold_tool_calls(rows)


@query(f"with c as ({_CALL}), r as (select source, session_id, tool_use_id, arg_max(flag, seq) as e from c where id % 2 = 1 and flag is not null group by all) select c.source, c.session_id, c.tool_use_id, c.seq, coalesce(r.e, c.flag) as is_error from c left join r using (source, session_id, tool_use_id) where c.id % 2 = 0")
def tool_calls_with_results(spark, sf_dir):
    rows = _calls(spark, sf_dir).select(*_BY_TOOL, "seq", "id", F.col("flag").alias("is_error"))
    return store.with_results(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).drop("id")


@query(f"""with c as ({_CALL}), e as (select source, session_id, tool_use_id, arg_max(message_id, seq) as message_id, arg_max('/f' || cast(id as varchar), seq) as file_path, arg_max('Edit', seq) as tool_name, arg_max(ts_ms, seq) as ts_ms, arg_max('b' || cast(id as varchar), seq) filter (id % 3 = 0) as git_branch, arg_max(project, seq) filter (project is not null) as cwd from c where id % 2 = 0 group by all),
r as (select source, session_id, tool_use_id, arg_max(id, seq) as la, arg_max(id + 1, seq) as lr, arg_max('/r' || cast(id as varchar), seq) filter (id % 5 < 2) as file_path, arg_max('p' || cast(id as varchar), seq) filter (id % 3 = 1) as patch, arg_max(flag, seq) filter (flag is not null) as um from c where id % 2 = 1 group by all)
select e.source, e.session_id, e.tool_use_id, tool_name, coalesce(r.file_path, e.file_path) as file_path, git_branch, cwd, e.message_id, e.ts_ms, la as lines_added, lr as lines_removed, patch as structured_patch_json, um as user_modified from e left join r using (source, session_id, tool_use_id)""")
def fold_file_edits(spark, sf_dir):
    rows, n, none = _calls(spark, sf_dir), F.col("id").cast("string"), F.lit(None).cast("string")
    calls = rows.where("id % 2 = 0").select(*_BY_TOOL, "seq", "message_id", F.concat(F.lit("/f"), n).alias("file_path"), F.lit("Edit").alias("tool_name"), "ts_ms", F.when(F.col("id") % 3 == 0, F.concat(F.lit("b"), n)).alias("git_branch"), F.col("project").alias("cwd"))
    results = rows.where("id % 2 = 1").select(*_BY_TOOL, "seq", "message_id", F.when(F.col("id") % 5 < 2, F.concat(F.lit("/r"), n)).alias("file_path"), F.col("id").alias("lines_added"), (F.col("id") + 1).alias("lines_removed"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("p"), n)).alias("structured_patch_json"), F.col("flag").alias("user_modified"), "ts_ms", none.alias("git_branch"), none.alias("cwd"))
    return store.fold_file_edits(calls, results)

# files of whole documents
_T = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"""with l as (select *, {_T} as t, row_number() over (partition by session_id, source order by id) as k from session_events_v),
p as (select session_id, source, id, t, ts_ms, row_number() over (partition by session_id, source order by id) - 1 as n from l where role = 'user' and id % 4 <> 3 and t <> '')
select 'grok' as source, session_id || '-' || source as session_id, '/g/' || session_id as project, t as prompt, 1704067200000 + n as timestamp_ms from p""")
def read_grok_prompts(spark, sf_dir):
    """Chat lines and their folder's summary; a prompt's time is the start plus its number, of those that weren't made up."""
    e = view(spark, sf_dir, "session_events_v")
    name = F.concat("session_id", F.lit("-"), "source")
    said = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content"), F.when(F.col("id") % 4 == 3, "x").alias("synthetic_reason"))))
    parts = F.to_json(F.struct(F.col("role").alias("type"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), F.when(F.col("id") % 4 == 3, "x").alias("synthetic_reason")))
    lines = e.select(F.concat(F.lit("/c/"), name, F.lit("/chat_history.jsonl")).alias("path"), F.col("id").alias("line"), F.parse_json(F.coalesce(said, parts)).alias("v"))
    info = F.struct(F.struct(name.alias("id"), F.concat(F.lit("/g/"), "session_id").alias("cwd")).alias("info"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    notes = e.select("session_id", "source").distinct().select(F.concat(F.lit("/c/"), name).alias("folder"), F.parse_json(F.to_json(info)).alias("s"))
    return logs.grok_rows(lines, notes)[0].select("source", "session_id", "project", "prompt", "timestamp_ms")


_RUNS = "select doc_id, 'run-' || cast(doc_id as varchar) as id, source, lang, strftime(make_timestamp((1704067200000 + doc_id * 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as moment, 'why ' || cast(doc_id as varchar) as q, 'pick ' || cast(doc_id % 9 as varchar) as c from documents"


def _run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, at = F.col("doc_id").cast("string"), F.date_format(F.timestamp_millis(F.lit(1704067200000) + F.col("doc_id") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    choice = F.to_json(F.struct(F.concat(F.lit("why "), n).alias("question"), F.concat(F.lit("pick "), (F.col("doc_id") % 9).cast("string")).alias("chosen"), F.array(F.lit("other")).alias("alternatives")))
    head = F.concat(F.lit('{"id":"run-'), n, F.lit('","personaId":"'), "source", F.lit('","projectId":"'), "lang", F.lit('","'), F.when(F.col("doc_id") % 2 == 0, "completedAt").otherwise("startedAt"), F.lit('":"'), at, F.lit('",'))
    run = F.concat(head, F.lit('"decisions":['), choice, F.lit(',7],"retrospective":{"summary":"done","confidence":0.5}}'))
    roll = F.concat(head, F.lit('"type":"compacted","sourceTrajectories":["r"],"narrative":"told '), n, F.lit('","keyFindings":["found",""],"lessons":[{"lesson":"learn","context":"con"}],"decisions":['), choice, F.lit("]}"))
    doc = F.when(F.col("doc_id") % 3 == 0, roll).when(F.col("doc_id") % 10 == 1, "not json").otherwise(run)
    return d.select(F.concat(F.lit("/t/"), n, F.lit(".json")).alias("path"), F.lit(0).cast("long").alias("updated_ms"), F.try_parse_json(doc).alias("v")).where("v is not null")


@query(f"""with r as ({_RUNS}) select id, source as persona_id, lang as project_id, case when doc_id % 2 = 1 then moment end as started_at, case when doc_id % 2 = 0 then moment end as completed_at, 1704067200000 + doc_id * 1000 as timestamp_ms,
array_to_string(list_concat([id, source, lang, q, c, 'other'], case when doc_id % 3 = 0 then ['told ' || cast(doc_id as varchar), 'found', 'con', 'learn'] else ['done', '0.5'] end), chr(10)) as search_text from r where doc_id % 3 = 0 or doc_id % 10 <> 1""")
def read_trajectories(spark, sf_dir):
    return logs.trajectory_rows(_run_files(spark, sf_dir)).select("id", "persona_id", "project_id", "started_at", "completed_at", "timestamp_ms", "search_text")


@query(f"""with r as ({_RUNS}), e as (
select id, 0 as ord, 'decision' as kind, 'decision:' || id || ':0' as event_id, 'Question: ' || q || chr(10) || 'Chose: ' || c || chr(10) || 'Alternatives: other' as content from r where doc_id % 3 <> 0 and doc_id % 10 <> 1
union all select id, 1, 'reflection', 'reflection:' || id || ':summary', 'done' from r where doc_id % 3 <> 0 and doc_id % 10 <> 1
union all select id, 0, 'decision', 'decision:' || id || ':0', 'Question: ' || q || chr(10) || 'Chose: ' || c from r where doc_id % 3 = 0
union all select id, 1, 'reflection', 'reflection:' || id || ':lesson:0', 'Context: con' || chr(10) || 'Lesson: learn' from r where doc_id % 3 = 0
union all select id, 2, 'finding', 'finding:' || id || ':keyfinding:0', 'found' from r where doc_id % 3 = 0
union all select id, 3, 'reflection', 'reflection:' || id || ':summary', 'told ' || cast(doc_id as varchar) from r where doc_id % 3 = 0)
select id as session_id, kind, event_id, content from e""")
def convergence_decisions(spark, sf_dir):
    """Events of trajectories and of roll-ups with their decisions."""
    runs = logs.trajectory_rows(_run_files(spark, sf_dir)).withColumn("rowid", F.substring("id", 5, 20).cast("long"))
    return convergence.trajectory_events(runs).select("session_id", "kind", "event_id", "content")


def _through_sqlite(history: DataFrame) -> DataFrame:
    """Exported as SQLite files by tasks, and read back in ranges of rows."""
    folder = scratch(history.sparkSession, "sqlite").removeprefix("file://")
    sqlite.export_history(history, folder)
    return sqlite.imported_history(history.sparkSession, folder)


_on("sqlite_round_trip", "select source, session_id, project, prompt, substr(sha256(prompt), 1, 16) as prompt_hash, timestamp_ms from history_v where prompt <> ''", _through_sqlite, "history_v")


@query(f"""with l as (select * from ({ORACLE_SQL["commit_link_rows"]}))
select cast(commit_sha as varchar) as commit_sha, source, session_id, repo, confidence, 'f' || cast(commit_sha as varchar) as first_file, distance from l""")
def exported_commit_links(spark, sf_dir):
    """Links as lines of JSON, with nested values where the table keeps texts."""
    commits = _commits(spark, sf_dir)
    changes = commits.select("commit_sha", F.concat(F.lit("f"), F.col("commit_sha").cast("string")).alias("file_path"), F.lit(1).cast("long").alias("lines_added"), F.lit(None).cast("long").alias("lines_removed"))
    lines = links.exported_links(links.link_rows(links.best_candidates(view(spark, sf_dir, "sessions_v"), commits), commits, changes, "time", 5))
    told = {"commit_sha": ("$.commit_sha", "string"), "source": ("$.source", "string"), "session_id": ("$.session_id", "string"), "repo": ("$.repo", "string"), "confidence": ("$.confidence", "double"), "first_file": ("$.files_json[0]", "string"), "distance": ("$.evidence_json.candidate.time_distance_ms", "long")}
    return lines.select(*(F.get_json_object("value", p).cast(t).alias(c) for c, (p, t) in told.items()))


@query(f"""with h as (select id, source, coalesce(session_id, 'none') as session_id, project, prompt, timestamp_ms from history_v), a as (select source, session_id, min(project) as project, cast(count(*) as varchar) as n from h group by all)
select 'learn_' || substr(sha256(source || ':' || session_id), 1, 16) as id, project as project_id, 'title ' || n as task_title, 'told ' || n as search_text, cast(4 as bigint) as events from a""")
def learn_roll_ups(spark, sf_dir):
    """Roll-ups from a model's fenced answers, one a session, and how many events each will make."""
    h = view(spark, sf_dir, "history_v").withColumn("session_id", F.coalesce("session_id", F.lit("none")))
    n = F.count("*").cast("string")
    answer = F.concat(F.lit('```json\n{"title":"title '), n, F.lit('","narrative":"told '), n, F.lit('","decisions":[{"question":"q","chosen":"c"}],"lessons":[{"lesson":"l"}],"keyFindings":["f"," "],"keyLearnings":["k"]}\n```'))
    rolls = learn.roll_ups(h.groupBy("source", "session_id").agg(F.min("project").alias("project"), answer.alias("answer")), 5)
    return rolls.join(learn.event_estimate(rolls), "id").select("id", "project_id", "task_title", "search_text", F.col("events").cast("long").alias("events"))


@query(r"""select doc_id, 'b_' || substr(sha256('m:' || cast(doc_id as varchar) || ':9:0:' || cast(doc_id % 7 as varchar) || ':3'), 1, 16) as batch, strftime(make_timestamp((1704067200000 + doc_id * 1000) * 1000), '%Y-%m-%dT%H:%M:%S+00:00') as learned, strftime(make_timestamp((1704067200000 + doc_id * 60000) * 1000), '%Y-%m-%d %H:%M') as minute,
'/' || replace('a-b-' || cast(doc_id as varchar), '-', '/') as cursor_project, 'x ' || cast(doc_id as varchar) || 'é%zz' as decoded, 'hi ' || cast(doc_id as varchar) as untagged, case doc_id % 3 when 0 then '/f' || cast(doc_id as varchar) when 1 then 'ls ' || cast(doc_id as varchar) else 'pat' end as target,
case doc_id % 3 when 0 then 'Edit' when 1 then 'Bash' else 'Grep' end = 'Edit' as is_edit, regexp_replace(source, '[[:cntrl:]]', '', 'g') || '…' as cell from (select * from documents)""")
def name_scalars(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    tool = F.when(k == 0, "Edit").when(k == 1, "Bash").otherwise("Grep")
    args = F.to_json(F.struct(F.when(k == 0, F.concat(F.lit("/f"), n)).alias("file_path"), F.when(k == 1, F.concat(F.lit("ls "), n)).alias("command"), F.when(k == 2, "pat").alias("pattern")))
    zero = F.lit(0).cast("long")
    return d.select(
        "doc_id", S.batch_id(F.lit("m"), F.col("doc_id"), F.lit(9), zero, F.col("doc_id") % 7, F.lit(3)).alias("batch"), S.iso_offset_time(F.lit(1704067200000) + F.col("doc_id") * 1000).alias("learned"), S.minute(F.lit(1704067200000) + F.col("doc_id") * 60000).alias("minute"),
        S.cursor_project(F.concat(F.lit("a-b-"), n)).alias("cursor_project"), S.percent_decoded(F.concat(F.lit("x%20"), n, F.lit("%c3%a9%zz"))).alias("decoded"), S.without_query_tag(F.concat(F.lit(" <user_query>\nhi "), n, F.lit("\n</user_query> "))).alias("untagged"),
        S.tool_target(tool, args).alias("target"), S.is_edit_tool(tool).alias("is_edit"), F.concat(S.safe_cell(F.concat("source", F.lit("\x07"))), F.lit("…")).alias("cell"),
    )


@query("""with p as (select page_id as commit_sha, regexp_replace(url, '^https?://[^/]*/|[?#].*$', '', 'g') as f, url from pages)
select commit_sha, commit_sha * 1000 as commit_ms, case when commit_sha % 3 > 0 then 'b' || cast(commit_sha % 3 as varchar) end as branch, url as repo_remote, f as name, commit_sha % 50 as added, case when commit_sha % 5 > 0 then commit_sha % 7 end as removed from p where regexp_replace(f, '^\\s+|\\s+$', '', 'g') <> '' and not contains(f, chr(9))""")
def commit_scan(spark, sf_dir):
    """What git prints for each commit, as commits, names and changed lines."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.regexp_replace("url", r"^https?://[^/]*/|[?#].*$", "").alias("f")).where(~F.contains("f", F.lit("\t")))
    n = F.col("page_id").cast("string")
    removed = F.when(F.col("page_id") % 5 > 0, (F.col("page_id") % 7).cast("string")).otherwise("-")
    outputs = p.select(
        F.col("page_id").alias("commit_sha"), F.lit("/r\n").alias("root"), F.concat(n, F.lit("\n")).alias("time"), F.when(F.col("page_id") % 3 == 0, "HEAD\n").otherwise(F.concat(F.lit("b"), (F.col("page_id") % 3).cast("string"))).alias("branch"),
        F.concat(F.regexp_replace("url", "^(https?://)", "$1me:pw@"), F.lit("\n")).alias("remote"), F.concat("f", F.lit("\r\n\n")).alias("names"), F.concat((F.col("page_id") % 50).cast("string"), F.lit("\t"), removed, F.lit("\t"), "f", F.lit("\n")).alias("numstat"),
    )
    commits, names, changes = links.commit_scan(outputs)
    rows = commits.join(names, "commit_sha").join(changes.select("commit_sha", "lines_added", "lines_removed"), "commit_sha")
    return rows.select("commit_sha", "commit_ms", "branch", "repo_remote", F.col("file_path").alias("name"), F.col("lines_added").alias("added"), F.col("lines_removed").alias("removed"))
