import json
import sqlite3

from pyspark.sql import functions as F

from annalist.operators import learn
from annalist.operators.convergence import trajectory_events
from annalist.sources import logs, sqlite


def test_sqlite_round_trip_and_opencode(spark, tmp_path):
    history = spark.createDataFrame([(2, "claude", "s", "/p", "b", 20), (1, "codex", None, None, "a", 10)], "id long, source string, session_id string, project string, prompt string, timestamp_ms long")
    path = str(tmp_path / "out")
    sqlite.export_history(history, path)
    got = sqlite.imported_history(spark, path).orderBy("timestamp_ms").collect()
    assert [(r.prompt, r.source, r.project) for r in got] == [("a", "codex", None), ("b", "claude", "/p")] and all(len(r.prompt_hash) == 16 for r in got)
    db = sqlite3.connect(tmp_path / "old.db")
    with db:
        db.execute("create table history (source text, session_id text, project text, prompt text, timestamp_ms integer)")
        db.execute("insert into history values ('claude', 's', null, 'x', 1)")
    assert sqlite.imported_history(spark, str(tmp_path / "old.db")).first().prompt_hash is not None
    db = sqlite3.connect(tmp_path / "oc.db")
    with db:
        db.execute("create table session (id text, directory text, time_created integer)")
        db.execute("create table message (id text, session_id text, time_created integer, data text)")
        db.execute("create table part (id text, message_id text, session_id text, time_created integer, data text)")
        db.execute("insert into session values ('s', '/d', 1)")
        db.execute("insert into message values ('m', 's', 2, ?)", (json.dumps({"role": "user"}),))
        db.execute("insert into part values ('p', 'm', 's', 3, ?)", (json.dumps({"type": "text", "text": "hi"}),))
    assert [(r.prompt, r.timestamp_ms) for r in logs.opencode_prompts(*sqlite.opencode(spark, str(tmp_path / "oc.db"))).collect()] == [("hi", 3)]


def test_export_writes_a_file_a_task(spark, tmp_path):
    rows = spark.range(5000).select("id", F.lit("claude").alias("source"), F.lit(None).cast("string").alias("session_id"), F.lit("/p").alias("project"), F.concat(F.lit("p"), "id").alias("prompt"), (F.col("id") * 7).alias("timestamp_ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sqlite.export_history(rows, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 4 and all(n.startswith("part-") and n.endswith(".db") for n in names)
    times = [sqlite3.connect(tmp_path / "out" / n).execute("select min(timestamp_ms), max(timestamp_ms) from history").fetchone() for n in names]
    assert all(a[1] < b[0] for a, b in zip(times, times[1:]))
    assert sqlite.imported_history(spark, str(tmp_path / "out")).select("prompt", "timestamp_ms").exceptAll(rows.select("prompt", "timestamp_ms")).count() == 0
    assert sqlite.imported_history(spark, str(tmp_path / "out")).count() == 5000
    bad = rows.withColumn("source", F.when(F.col("id") < 4000, "claude").otherwise(F.raise_error(F.lit("lost"))))
    with __import__("pytest").raises(Exception, match="lost"):
        sqlite.export_history(bad, str(tmp_path / "bad"))
    assert [p for p in (tmp_path / "bad").iterdir() if p.name.endswith(".db")] == []


def test_learn(spark):
    events = spark.createDataFrame([(i, "claude", "s", 1000 * i, "user", "word " * 5) for i in range(10)], "id long, source string, session_id string, ts_ms long, role string, text string")
    text = learn.transcripts(events, budget=100).first().transcript
    assert len(text.split("\n")) == 2 and text.startswith("[user 1970-01-01T00:00:00.000Z] word")
    answer = "```json\n" + json.dumps({"title": "T", "decisions": [{"question": "q", "chosen": "c"}], "keyLearnings": ["k"], "narrative": "n"}) + "\n```"
    candidates = spark.createDataFrame([("claude", "s", "/p"), ("codex", "none", "/p")], "source string, session_id string, project string")
    rolls = learn.distil(events, candidates, lambda df: df.withColumn("answer", F.lit(answer)), 5)
    r = rolls.first()
    assert rolls.count() == 1 and r.id.startswith("learn_") and r.task_title == "T" and learn.event_estimate(rolls).first().events == 2
    none = F.lit(None).cast("string")
    full = rolls.withColumns({"rowid": F.lit(1), "persona_id": none, "task_description": none, "status": F.lit("x"), "decisions_json": F.lit("[]")})
    assert [e.kind for e in trajectory_events(full).orderBy("ord").collect()] == ["decision", "finding"]
    merged = learn.merged_roll_ups(full, rolls.withColumn("task_title", F.lit("T2"))).first()
    assert merged.task_title == "T2" and merged.status == "x"
