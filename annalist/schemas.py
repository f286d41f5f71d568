"""Schemas of the history store; never inferred. Flags stay integers, times are epoch milliseconds in UTC."""

from __future__ import annotations

SOURCES = ("claude", "codex", "cursor", "grok", "relay", "trajectory", "opencode")
ROLES = ("user", "assistant", "tool_result")
KINDS = ("text", "thinking", "tool_use", "tool_result")

HISTORY = "id long, source string, session_id string, project string, prompt string, prompt_hash string, timestamp_ms long, git_branch string"
SESSION_EVENTS = (
    "id long, source string, session_id string, project string, cwd string, git_branch string, message_id string, parent_id string,"
    " ts_ms long, role string, kind string, text string, model string, token_json string, event_uid string"
)
TOOL_CALLS = "id long, source string, session_id string, message_id string, tool_use_id string, name string, target string, args_json string, is_error int, ts_ms long"
FILE_EDITS = (
    "id long, source string, session_id string, message_id string, tool_use_id string, file_path string, tool_name string, lines_added long,"
    " lines_removed long, structured_patch_json string, user_modified int, ts_ms long, git_branch string, cwd string"
)
COMMIT_LINKS = (
    "id long, source string, session_id string, repo string, branch string, commit_sha string, note_ref string, match_method string,"
    " confidence double, files_json string, numstat_json string, evidence_json string, created_at_ms long"
)
TRAJECTORIES = (
    "rowid long, id string, version long, persona_id string, project_id string, task_title string, task_description string, status string,"
    " started_at string, completed_at string, decisions_json string, retrospective_json string, search_text string, path string, updated_ms long, timestamp_ms long"
)
TAGS = "id long, name string, display_name string, color string, created_ms long, updated_ms long"
SESSION_TAGS = "id long, source string, session_id string, tag_id long, created_ms long"
SESSIONS = "session_id string, source string, cwd string, git_branch string, first_activity_ms long, last_activity_ms long, last_assistant_text string, raw_path string, parser_version int"

#: Unique keys, by which the store's writers fold rows.
KEYS = {
    "history": ("source", "timestamp_ms", "prompt"),
    "session_events": ("source", "session_id", "event_uid"),
    "tool_calls": ("source", "session_id", "tool_use_id"),
    "file_edits": ("source", "session_id", "tool_use_id"),
    "session_commit_links": ("source", "session_id", "commit_sha", "match_method"),
    "trajectories": ("id",),
    "tags": ("name",),
    "session_tags": ("source", "session_id", "tag_id"),
    "sessions": ("session_id", "source"),
}


def check_source(source: str | None) -> str | None:
    """The source itself, or an error that names the known ones."""
    if source is not None and source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(SOURCES)}")
    return source
