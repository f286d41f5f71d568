"""The driver's tables seen as the store's tables; the same SQL serves Spark and DuckDB unless two are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_OF = "case {0} % 7 when 0 then 'claude' when 1 then 'codex' when 2 then 'cursor' when 3 then 'grok' when 4 then 'relay' when 5 then 'trajectory' else 'opencode' end"

SESSION_EVENTS = f"""
select conv_id * 1000 + turn as id, {SOURCE_OF.format("conv_id")} as source, concat('conv-', cast(conv_id as string)) as session_id,
  case when conv_id % 11 = 0 then null else concat('/work/p', cast(conv_id % 5 as string), case when conv_id % 2 = 0 then '/pkg' else '' end) end as project,
  case when role = 'system' then 'tool_result' else role end as role, case when role = 'system' then 'tool_result' else 'text' end as kind,
  text, 1704067200000 + conv_id * 120000 + turn * 60000 as ts_ms
from conversations"""

HISTORY = """
select id, source, case when id % 13 = 0 then null else session_id end as session_id, project, text as prompt, ts_ms as timestamp_ms
from session_events_v where role = 'user'"""

SESSIONS = """
select session_id, source, min(project) as cwd, concat('feat/b', cast(min(id) % 4 as string)) as git_branch,
  min(ts_ms) as first_activity_ms, max(ts_ms) as last_activity_ms from session_events_v group by session_id, source"""

TAGS = """
select cast(1 as bigint) as id, 'quality' as name, 'Quality' as display_name, 'blue' as color, cast(0 as bigint) as created_ms, cast(0 as bigint) as updated_ms
union all select 2, 'toxic', 'Toxic', null, 0, 0 union all select 3, 'unused tag', 'Unused  Tag', null, 0, 0"""

SESSION_TAGS = f"""
select doc_id * 10 + t.id as id, {SOURCE_OF.format("doc_id")} as source, concat('conv-', cast(doc_id as string)) as session_id, t.id as tag_id, 1704067200000 + doc_id as created_ms
from labels join tags_v t on (t.id = 1 and quality = 1) or (t.id = 2 and toxic = 1)"""

ORDERS_HISTORY = """
select o_orderkey as id, 'claude' as source, concat('cust-', cast(o_custkey as string)) as session_id, o_orderpriority as project,
  concat(o_orderstatus, ' ', o_orderpriority) as prompt, {ms} as timestamp_ms from orders"""

EVENT_STREAM = """
select event_id as id, concat('m', cast(user_id as string)) as machine_id, event_type as kind, {ms} as ts_ms, value,
  cast({k} as bigint) as k from events"""

DOCUMENT_HISTORY = """
select doc_id as id, source, concat('doc-', cast(doc_id % 97 as string)) as session_id, concat('/docs/', lang) as project, text as prompt, 1704067200000 + doc_id * 1000 as timestamp_ms
from documents"""

SPARK = {
    "session_events_v": SESSION_EVENTS, "history_v": HISTORY, "sessions_v": SESSIONS, "tags_v": TAGS, "session_tags_v": SESSION_TAGS, "document_history_v": DOCUMENT_HISTORY,
    "orders_history_v": ORDERS_HISTORY.format(ms="unix_millis(cast(o_orderdate as timestamp))"),
    "event_stream_v": EVENT_STREAM.format(ms="unix_millis(cast(ts as timestamp))", k="get_json_object(props, '$.k')"),
}
DUCKDB = SPARK | {
    "orders_history_v": ORDERS_HISTORY.format(ms="epoch_us(o_orderdate) // 1000"),
    "event_stream_v": EVENT_STREAM.format(ms="epoch_us(ts) // 1000", k="json_extract_string(props, '$.k')"),
}
_ORDER = ("session_events_v", "history_v", "sessions_v", "tags_v", "session_tags_v", "document_history_v", "orders_history_v", "event_stream_v")
_TABLES = {"session_events_v": "conversations", "session_tags_v": "labels", "document_history_v": "documents", "orders_history_v": "orders", "event_stream_v": "events"}
_NEEDS = {"history_v": ["session_events_v"], "sessions_v": ["session_events_v"], "session_tags_v": ["tags_v"]}


def _closure(names) -> list[str]:
    wanted, todo = set(), list(names)
    while todo:
        n = todo.pop()
        wanted.add(n)
        todo += _NEEDS.get(n, [])
    return [n for n in _ORDER if n in wanted]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    names = _closure([n for n in _ORDER if n in sql])
    head = ", ".join(f"{n} as ({DUCKDB[n].strip()})" for n in names)
    body = sql.strip()
    if not head:
        return body
    return f"with {head}, {body[5:]}" if body[:5].lower() == "with " else f"with {head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder, as a DataFrame without names in the session's catalog."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for n in _closure([name]) if (t := _TABLES.get(n))}
    for n in _closure([name]):
        used = {x: y for x, y in tables.items() if x in SPARK[n]}
        tables[n] = spark.sql(_named(SPARK[n], used), **used) if used else spark.sql(SPARK[n])
    return tables[name]


def _named(sql: str, used: dict) -> str:
    for n in sorted(used, key=len, reverse=True):
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {n}", f"{word} {{{n}}}")
    return sql
