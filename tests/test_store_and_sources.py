import json

import pytest
from pyspark.sql import functions as F

from annalist.operators import convergence, search, sessions, store
from annalist.operators.store import Store
from annalist.schemas import HISTORY
from annalist.sources import everything, growing, logs
from annalist.streaming import ingest


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_claude_and_codex_prompts(spark, tmp_path):
    lines(tmp_path / "c/history.jsonl", [{"display": " fix it \n", "timestamp": 1000, "project": "/p", "sessionId": "s1"}, {"display": "  "}, "not json", {"display": "late", "timestamp": "x"}])
    rows = {r.prompt: r for r in logs.claude_prompts(logs.json_lines(spark, str(tmp_path / "c"))).collect()}
    assert set(rows) == {"fix it", "late"} and rows["fix it"].timestamp_ms == 1000 and rows["late"].timestamp_ms == 0 and rows["fix it"].session_id == "s1"
    assert logs.bad_lines(logs.json_lines(spark, str(tmp_path / "c"))).first().bad == 1
    lines(tmp_path / "x/history.jsonl", [{"text": "run", "ts": 12.5, "session_id": "a"}, {"text": "go", "ts": 3, "sessionId": "b"}])
    lines(tmp_path / "r/2024/rollout-1.jsonl", [{"type": "session_meta", "payload": {"id": "a", "cwd": "/w", "git": {"branch": "main"}}}, {"type": "other"}])
    rolls = logs.codex_rollouts(spark, str(tmp_path / "r"))
    got = {r.prompt: (r.session_id, r.project, r.timestamp_ms) for r in logs.codex_prompts(logs.json_lines(spark, str(tmp_path / "x")), rolls).collect()}
    assert got == {"run": ("a", "/w", 12500), "go": ("b", None, 3000)}


def test_rich_transcript(spark, tmp_path):
    lines(tmp_path / "t/s.jsonl", [
        {"type": "user", "sessionId": "S", "cwd": "/w", "gitBranch": "a", "timestamp": "2024-01-01T00:00:00Z", "uuid": "u1", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "sessionId": "S", "gitBranch": "b", "timestamp": "2024-01-01T00:01:00Z", "uuid": "u2", "parentUuid": "u1", "message": {"role": "assistant", "model": "m", "usage": {"in": 1}, "content": [{"type": "text", "text": "done"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/a.py"}}]}},
        {"type": "user", "sessionId": "S", "uuid": "u3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": False, "content": "ok", "toolUseResult": {"filePath": "/w/a.py", "structuredPatch": "@@\n+x\n-y\n", "userModified": True}}]}},
    ])
    rows = logs.json_lines(spark, str(tmp_path / "t"))
    meta = logs.claude_sessions(rows).first()
    assert (meta.session_id, meta.cwd, meta.git_branch, meta.last_assistant_text, meta.last_activity_ms - meta.first_activity_ms) == ("S", "/w", "b", "done", 60000)
    blocks = logs.claude_blocks(rows).cache()
    events = store.fold_events(logs.claude_events(blocks)).orderBy("event_uid").collect()
    assert [(e.event_uid, e.role, e.kind, e.text) for e in events] == [("u1:0", "user", "text", "hello"), ("u2:0", "assistant", "text", "done"), ("u2:1", "assistant", "tool_use", "Edit /w/a.py"), ("u3:0", "tool_result", "tool_result", "ok")]
    calls, results = logs.claude_tool_calls(blocks), logs.claude_results(blocks)
    call = store.with_results(store.fold_tool_calls(calls.drop("git_branch", "cwd")), results).first()
    assert (call.name, call.target, call.is_error) == ("Edit", "/w/a.py", 0)
    edit = store.fold_file_edits(logs.claude_edit_calls(calls), results.where("is_edit")).first()
    assert (edit.file_path, edit.lines_added, edit.lines_removed, edit.user_modified, edit.message_id) == ("/w/a.py", 1, 1, 1, "u2")


def test_cursor_grok_trajectories(spark, tmp_path):
    lines(tmp_path / "cur/my-proj/agent-transcripts/sid/sid.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>\nhi\n</user_query>"}]}}, {"role": "assistant", "message": {"content": "no"}}])
    row = logs.cursor_prompts(logs.json_lines(spark, str(tmp_path / "cur"))).first()
    assert (row.prompt, row.session_id, row.project) == ("hi", "sid", "/my/proj") and row.timestamp_ms > 0
    lines(tmp_path / "g/x/chat_history.jsonl", [{"type": "user", "content": [{"type": "text", "text": "a"}]}, {"type": "user", "synthetic_reason": "r", "content": "skip"}, {"type": "assistant", "content": "ans"}, {"type": "user", "content": "b"}])
    (tmp_path / "g/x/summary.json").write_text(json.dumps({"info": {"id": "G", "cwd": "/g"}, "created_at": "2024-01-01T00:00:00Z", "head_branch": "main"}))
    prompts, summary = logs.grok_sessions(spark, str(tmp_path / "g"))
    assert [(r.prompt, r.timestamp_ms) for r in prompts.orderBy("timestamp_ms").collect()] == [("a", 1704067200000), ("b", 1704067200001)]
    assert summary.first().last_assistant_text == "ans"
    (tmp_path / "tr").mkdir()
    (tmp_path / "tr/one.json").write_text(json.dumps({"id": "r1", "personaId": "p", "task": {"title": "T"}, "completedAt": "2024-01-02T00:00:00Z", "decisions": [{"question": "Q", "chosen": "C", "alternatives": ["z"]}, 5], "retrospective": {"summary": "S", "confidence": 0.5, "learnings": ["L"]}}))
    (tmp_path / "tr/index.json").write_text('{"id": "no"}')
    (tmp_path / "tr/roll.json").write_text(json.dumps({"id": "c1", "type": "compacted", "sourceTrajectories": ["r1"], "compactedAt": "2024-01-03T00:00:00Z", "lessons": [{"lesson": "less", "context": "con"}], "narrative": "N"}))
    got = {r.id: r for r in logs.trajectories(spark, str(tmp_path / "tr")).collect()}
    assert set(got) == {"r1", "c1"} and got["r1"].timestamp_ms == 1704153600000
    assert got["r1"].search_text.split("\n") == ["r1", "p", "T", "Q", "C", "z", "S", "0.5", "L"] and json.loads(got["r1"].decisions_json) == [{"question": "Q", "chosen": "C", "alternatives": ["z"]}]
    assert got["c1"].search_text.split("\n") == ["c1", "N", "con", "less"] and json.loads(got["c1"].retrospective_json)["type"] == "compacted"


def test_export_import_and_idempotent_sync(spark, tmp_path):
    lines(tmp_path / "c/history.jsonl", [{"display": f"p{i % 4}", "timestamp": i % 4, "sessionId": "s"} for i in range(8)] + ["not json"])
    kept, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "c")
    assert ingest.sync_lines(kept, "claude", folder, logs.claude_prompts) == {"added": 4, "lines": 9, "bad": 1}
    assert ingest.sync_lines(kept, "claude", folder, logs.claude_prompts) == {"added": 0, "lines": 0, "bad": 0}
    with (tmp_path / "c/history.jsonl").open("a") as f:
        f.write(json.dumps({"display": "new", "timestamp": 9}) + "\n" + json.dumps({"display": "half", "timestamp": 10}))
    assert ingest.sync_lines(kept, "claude", folder, logs.claude_prompts) == {"added": 1, "lines": 1, "bad": 0}
    with (tmp_path / "c/history.jsonl").open("a") as f:
        f.write("\n")
    assert ingest.sync_lines(kept, "claude", folder, logs.claude_prompts)["added"] == 1
    history = kept.history()
    assert sorted(r.id for r in history.collect()) == [1, 2, 3, 4, 5, 6]
    assert [r.prompt for r in search.search(history, "new").collect()] == ["new"] and history.where("prompt = 'new'").first().prompt_tokens == " new "
    out = logs.exported(history)
    back = logs.imported(out.union(spark.createDataFrame([("",), ("{bad",), ('{"prompt": ""}',)], "value string")))
    assert back.count() == 6
    total, first = logs.import_preview(back)
    assert total == 6 and first.count() == 5 and first.first().at == "1970-01-01 00:00"
    assert logs.import_into(kept, back) == {"inserted": 0, "skipped": 6} and logs.import_into(Store(spark, str(tmp_path / "other")), back) == {"inserted": 6, "skipped": 0}
    logs.write_export(history, str(tmp_path / "out"), gz=True, source="claude", since="1970-01-01")
    assert spark.read.text(str(tmp_path / "out")).count() == 6
    with pytest.raises(ValueError, match="No entries"):
        logs.write_export(history, str(tmp_path / "none"), source="grok")
    with pytest.raises(Exception, match="lacks source"):
        logs.imported(spark.createDataFrame([('{"prompt": "x"}',)], "value string")).collect()
    assert ingest.sync([("a", lambda: 1), ("b", lambda: 1 / 0)])["a"] == 1
    with pytest.raises(RuntimeError):
        ingest.sync([("b", lambda: 1 / 0)])


def test_byte_ranges_give_each_line_once(spark, tmp_path):
    rows = [f"line {i} " + "é" * (i % 50) for i in range(300)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_bytes(("\n".join(rows) + "\n").encode())
    (tmp_path / "in/b.jsonl").write_bytes(b"\r\n\nlast without end")
    none = spark.createDataFrame([], "path string, bytes long")
    for size in (7, 100, 1 << 20):
        got = growing.new_lines(spark, str(tmp_path / "in"), none, range_bytes=size).orderBy("path", "line").collect()
        assert [r.value for r in got] == [*rows, "", ""]
    part = growing.new_lines(spark, str(tmp_path / "in"), none, most=1000, range_bytes=100)
    seen = growing.progress(part)
    rest = growing.new_lines(spark, str(tmp_path / "in"), seen, range_bytes=64)
    assert sorted(r.value for r in part.unionByName(rest).where("value <> ''").collect()) == sorted(rows)


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"))

    def batch(rows):
        df = spark.createDataFrame([("claude", "s", None, p, None, t, None, (t,)) for p, t in rows], "source string, session_id string, project string, prompt string, prompt_hash string, timestamp_ms long, git_branch string, seq struct<t:long>")
        return kept.add_history(df)

    def files():
        return {f for f in (tmp_path / "store/history").rglob("*.parquet")}

    day = 86_400_000
    assert batch([(f"p{i}", i * day) for i in range(5)]) == 5
    old = files()
    assert batch([("p1", day), ("q", day), ("q", day)]) == 1
    assert old < files() and kept.history().count() == 6
    assert sum(spark.read.parquet(str(f)).count() for f in files() - old) == 1
    plan = kept.history().where("day = '1970-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    kept.save_cursors({"a": 5, "b": 1})
    kept.save_cursors({"a": 3})
    assert kept.cursors() == {"a": 5, "b": 1}


def test_stream_of_new_files(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"))
    for n in (1, 2):
        lines(tmp_path / f"in/f{n}.jsonl", [{"display": f"x{n}", "timestamp": n}, {"display": "same", "timestamp": 5}])
        ingest.watch_folder(spark, str(tmp_path / "in"), lambda b: kept.add_history(logs.claude_prompts(b)), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.prompt for r in kept.history().collect()) == ["same", "x1", "x2"]


def test_sessions_fold_over_runs_and_streams(spark, tmp_path):
    def transcript(name, branch, at, text):
        lines(tmp_path / f"in/{name}.jsonl", [{"type": "assistant", "sessionId": "S", "cwd": "/w", "gitBranch": branch, "timestamp": at, "message": {"content": text}}])

    kept = Store(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "source string, session_id string")
    some = spark.createDataFrame([("claude", "S")], "source string, session_id string")
    transcript("a", "one", "2024-01-01T00:00:00Z", "first")
    assert ingest.sync_sessions(kept, str(tmp_path / "in"), some, 1) == 1
    assert ingest.sync_sessions(kept, str(tmp_path / "in"), some, 2) == 0
    assert ingest.sync_sessions(kept, str(tmp_path / "in"), none, 3) == 1  # it has no events: read again
    transcript("b", "two", "2024-01-02T00:00:00Z", "second")
    assert ingest.sync_sessions(kept, str(tmp_path / "in"), some, 4) == 1
    r = kept.sessions().first()
    assert kept.sessions().count() == 1 and (r.git_branch, r.last_assistant_text, r.last_activity_ms - r.first_activity_ms) == ("two", "second", 86_400_000)
    live = Store(spark, str(tmp_path / "live"))
    ingest.watch_folder(spark, str(tmp_path / "in"), lambda b: live.add_sessions(logs.claude_sessions(b), 5), str(tmp_path / "ck")).awaitTermination()
    assert live.sessions().first().last_activity_ms == r.last_activity_ms


def test_beats_close_old_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id) as ts, 'm' as machine_id from range(60)").write.parquet(str(tmp_path / "e"))
    q = ingest.beats(spark, str(tmp_path / "e"), "ts timestamp, machine_id string").writeStream.format("memory").queryName("beats_test").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    rows = spark.table("beats_test").collect()
    assert 30 < len(rows) < 60 and all(r.records == 1 for r in rows)  # the last day's windows are still open


def test_all_sources_in_one(spark, tmp_path):
    lines(tmp_path / "c/history.jsonl", [{"display": "one", "timestamp": 1}, {"display": "one", "timestamp": 1}])
    lines(tmp_path / "x/history.jsonl", [{"text": "two", "ts": 2, "session_id": "a"}])
    for root in ("p/.trajectories", "q"):
        (tmp_path / root).mkdir(parents=True)
        (tmp_path / root / "r.json").write_text(json.dumps({"id": root[0], "task": {"title": "T"}, "completedAt": "2024-01-02T00:00:00Z"}))
    places = {"claude": str(tmp_path / "c"), "codex": str(tmp_path / "x"), "trajectory": [str(tmp_path / "p"), str(tmp_path / "q"), str(tmp_path / "p/.trajectories")]}
    got = sorted((r.source, r.session_id or "") for r in everything.prompts(spark, places).collect())
    assert got == [("claude", ""), ("codex", "a"), ("trajectory", "p"), ("trajectory", "q")]
    with pytest.raises(ValueError, match="unknown sources"):
        everything.prompts(spark, {"vim": "x"})


def test_opencode_relay_and_mirror(spark):
    s = spark.createDataFrame([("s", "/d", 1)], "id string, directory string, time_created long")
    m = spark.createDataFrame([("m", "s", 2, '{"role":"user"}'), ("n", "s", 2, '{"role":"assistant"}')], "id string, session_id string, time_created long, data string")
    p = spark.createDataFrame([("p", "m", "s", None, '{"type":"text","text":" hi "}'), ("q", "n", "s", 3, '{"type":"text","text":"no"}')], "id string, message_id string, session_id string, time_created long, data string")
    assert [(r.prompt, r.timestamp_ms, r.project) for r in logs.opencode_prompts(s, m, p).collect()] == [("hi", 2, "/d")]
    page = spark.createDataFrame([("#c", json.dumps({"ok": True, "data": [{"id": "7", "from_name": "bo", "text": "yo", "created_at": "2024-01-01T00:00:00Z"}, {"id": "8", "text": ""}]}))], "channel string, value string")
    r = logs.relay_messages(page).first()
    assert (r.prompt, r.session_id, r.timestamp_ms) == ("[bo] yo", "#c", 1704067200000) and logs.relay_cursors(page).first().after == "8"
    assert logs.relay_messages(page, logs.relay_cursors(page)).count() == 0
    history = spark.createDataFrame([(1, "claude", "a", None, "x", None, 1, None), (2, "trajectory", "t1", None, "old", None, 1, None)], HISTORY)
    runs = spark.createDataFrame([("t1", "/p", "new text", 5)], "id string, project_id string, search_text string, timestamp_ms long")
    assert sorted((r.id, r.prompt) for r in store.mirrored_trajectories(history, runs, 2).collect()) == [(1, "x"), (3, "new text")]


ROW = {"rowid": 1, "id": "run-7", "persona_id": "gardener", "project_id": None, "task_title": "Plant the north bed", "task_description": None, "status": None, "timestamp_ms": 1_710_498_600_250}
SCHEMA = "rowid long, id string, persona_id string, project_id string, task_title string, task_description string, status string, timestamp_ms long, decisions_json string, retrospective_json string"


def runs(spark, *rows):
    return spark.createDataFrame([tuple({**ROW, **r}.get(c.split()[0]) for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_trajectory_events(spark):
    """Each list makes one event an entry, numbered by its place among the entries that hold a text; blank ones make none."""
    choices = [
        {"question": "What goes first?", "chosen": "beans", "alternatives": ["kale", {"option": "leeks", "reason": "slow"}, {"reason": "cheap"}, "  ", 4]},
        {"question": " ", "confidence": 0.25},
        {"chosen": "path over /home/ines/yard", "reasoning": "dry", "confidence": 0.5},
    ]
    look = {"summary": "Bed is full", "confidence": 1, "learnings": [" ", {"description": "water early"}, "mulch"], "challenges": [{"value": "slugs"}, {"other": 1}], "suggestions": []}
    got = convergence.trajectory_events(runs(spark, {"decisions_json": json.dumps(choices), "retrospective_json": json.dumps(look)}, {"id": "", "retrospective_json": json.dumps(look)}, {"id": "odd", "decisions_json": "[1, 2]", "retrospective_json": "[]"})).orderBy("ord").collect()
    assert [(e.event_id, e.content, e.confidence) for e in got] == [
        ("decision:run-7:0", "Question: What goes first?\nChose: beans\nAlternatives: kale; leeks (slow); cheap", None),
        ("decision:run-7:2", "Chose: path over /home/~/yard\nBecause: dry", 0.5),
        ("reflection:run-7:summary", "Bed is full", 1.0),
        ("finding:run-7:learning:0", "water early", None),
        ("finding:run-7:learning:1", "mulch", None),
        ("finding:run-7:challenge:0", "slugs", None),
    ]
    assert [json.loads(e.record) for e in got[:2]] == [{"chosen": "beans", "alternatives": ["kale", "leeks (slow)", "cheap"]}, {"chosen": "path over /home/~/yard"}]
    assert {(e.ts, e.actor_name, e.task_title, e.source) for e in got} == {("2024-03-15T10:30:00.250Z", "gardener", "Plant the north bed", "trajectories")}


def test_roll_up_events(spark):
    """A roll-up has lists of its own; its tags replace the usual one, and the tag learn leaves out the narrative."""
    roll = {"id": "season", "type": "compacted", "sourceTrajectories": ["run-7", "run-8"], "narrative": "A wet spring", "keyLearnings": ["mulch twice", "", "net the peas"], "lessons": [7, {"lesson": "drain first", "recommendation": "dig a trench"}], "conventions": [{"pattern": "rows face south", "rationale": "light"}], "decisions": [{"question": "Which soil?", "impact": "less weeding"}]}
    rows = [{"id": f"season{i}", "decisions_json": json.dumps([{"chosen": "not read"}]), "retrospective_json": json.dumps({**roll, **more})} for i, more in enumerate([{}, {"tags": ["learn", " "], "source": "almanac", "lens": "yearly"}, {"sourceTrajectories": None}])]
    got = convergence.trajectory_events(runs(spark, *rows)).orderBy("session_id", "ord").collect()
    plain = [(e.kind, e.event_id.split(":", 2)[2], e.content) for e in got if e.session_id == "season0"]
    assert plain == [
        ("decision", "0", "Question: Which soil?\nImpact: less weeding"), ("reflection", "lesson:0", "Lesson: drain first\nRecommendation: dig a trench"),
        ("finding", "learning:0", "mulch twice"), ("finding", "learning:1", "net the peas"), ("reflection", "convention:0", "Pattern: rows face south\nRationale: light"), ("reflection", "summary", "A wet spring"),
    ]
    tagged = [e for e in got if e.session_id == "season1"]
    assert len(tagged) == len(plain) - 1 and {(e.source, e.lens, tuple(e.tags)) for e in tagged} == {("almanac", "yearly", ("learn",))}
    assert {tuple(e.tags) for e in got if e.session_id == "season0"} == {("compacted",)}
    assert [e.content for e in got if e.session_id == "season2"] == ["Chose: not read"]


def test_outbox_cap_and_push(spark):
    history = spark.createDataFrame([(i, "claude", "inc" if i == 2 else "s", None, f"p{i}", None, i, None) for i in range(1, 8)], HISTORY)
    retro = json.dumps({"learnings": ["a", "b", "c"]})
    traj = runs(spark, *({"rowid": i, "id": f"t{i}", "decisions_json": "[]", "retrospective_json": retro} for i in range(1, 4)))
    hidden = spark.createDataFrame([("inc",)], "session_id string")
    events, cursors = convergence.outbox_batch(history, traj, 0, 0, 100, hidden, cap=10)
    assert events.count() == 9 and cursors == {"history_id": 7, "trajectory_rowid": 1}
    events, cursors = convergence.outbox_batch(history, traj, 7, 1, 100, hidden, cap=2)
    assert events.count() == 3 and cursors["trajectory_rowid"] == 2
    sent, seen = [], []

    def send(name, rows):
        if rows.count() > 8:
            raise OverflowError
        sent.append(name)
        seen.extend(r.event_id for r in rows.collect())

    end = convergence.push(history, traj, {"history_id": 0, "trajectory_rowid": 0}, send, "m", 100, hidden)
    assert end == {"history_id": 7, "trajectory_rowid": 3} and len(seen) == len(set(seen)) == 15 and len(set(sent)) == len(sent) > 1


def test_handoff_goal_files_and_command(spark):
    history = spark.createDataFrame([(1, "claude", "s", "/w", "<system-reminder>x", None, 1, None), (2, "claude", "s", "/w", "fix src/app.py now", None, 2, None), (3, "claude", "s", "/w", "then `lib/b.ts`", None, 3, None)], HISTORY)
    summary = spark.createDataFrame([("s", "claude", "/w/it's", "feat/x", 1, 3, "ok")], "session_id string, source string, cwd string, git_branch string, first_activity_ms long, last_activity_ms long, last_assistant_text string")
    r = sessions.handoff(summary, history, branch="feat").first()
    assert r.goal == "fix src/app.py now" and r.files == ["src/app.py", "lib/b.ts"] and r.confidence == pytest.approx(0.51)
    assert r.warm_start.startswith("cd '/w/it'\\''s' && codex 'Picking up") and r.resume == "cd '/w/it'\\''s' && claude --resume s"


def test_folds_do_not_depend_on_partitions(spark):
    rows = [(f"k{i % 5}", i, None if i % 3 else f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    for n in (1, 7):
        part = df.repartition(n)
        assert {r.k: r.seq for r in store.first_wins(part, ("k",)).collect()} == {f"k{i}": i for i in range(5)}
        assert {r.k: r.seq for r in store.last_wins(part, ("k",)).collect()} == {f"k{i}": 55 + i for i in range(5)}
        assert {r.k: r.v for r in part.groupBy("k").agg(store.last_value("v").alias("v")).collect()} == {f"k{i}": f"v{max(j for j in range(60) if j % 5 == i and j % 3 == 0)}" for i in range(5)}
    assert [r.id for r in store.numbered(df, 10).orderBy("seq").collect()] == list(range(11, 71)) and F is not None
