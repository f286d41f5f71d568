import json
import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import store
from annalist.operators.store import Store
from annalist.sources import growing, logs
from annalist.streaming import folds, ingest


def put(path, rows, mode="a", end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows[:-1]) + json.dumps(rows[-1]) + end)


def test_growing_files_as_a_stream(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"))

    def run():
        query = ingest.watch_lines(kept, "claude", str(tmp_path / "in"), logs.claude_prompts, str(tmp_path / "ck"), range_bytes=200)
        query.awaitTermination()
        return query

    def line(n):
        return {"display": f"p{n} é", "timestamp": n}

    put(tmp_path / "in/a.jsonl", [line(n) for n in range(30)])
    put(tmp_path / "in/deep/b.jsonl", [line(n) for n in range(20, 40)], end="")  # the last line isn't whole yet
    put(tmp_path / "in/other.txt", [line(99)])
    run()
    assert sorted(r.timestamp_ms for r in kept.history().collect()) == list(range(39))
    with (tmp_path / "in/deep/b.jsonl").open("a") as f:
        f.write("\n")
    put(tmp_path / "in/a.jsonl", [line(n) for n in (50, 51, 3)])
    put(tmp_path / "in/c.jsonl", [line(60)])
    query = run()  # another query, from the same checkpoint
    assert query.recentProgress[0].numInputRows == 5  # only the bytes after those that were read
    assert sorted(r.timestamp_ms for r in kept.history().collect()) == [*range(40), 50, 51, 60]
    put(tmp_path / "in/c.jsonl", [{"display": "new", "timestamp": 70}], mode="w")  # shorter than before: read anew
    run()
    assert kept.history().where("prompt = 'new'").count() <= 1
    assert sorted(r.id for r in kept.history().collect()) == list(range(1, kept.history().count() + 1))


def test_offsets_end_with_whole_lines(tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"one\ntwo\nthree" + b"x" * 200_000)
    (tmp_path / "y.jsonl").write_bytes(b"none")
    reader = growing.GrowingReader({"path": str(tmp_path), "range_bytes": "5"})
    path = f"file://{tmp_path}/x.jsonl"
    assert reader.initialOffset() == {} and reader.latestOffset() == {path: 8}
    parts = reader.partitions({}, {path: 8})
    assert [(p.start, p.stop) for p in parts] == [(0, 5), (5, 8)]
    assert [v for p in parts for b in reader.read(p) for v in b.column(4).to_pylist()] == ["one", "two"]
    assert reader.partitions({path: 8}, {path: 8}) == [] and [p.first for p in reader.partitions({path: 20}, {path: 4})] == [0]
    again = growing.GrowingReader({"path": f"file://{tmp_path}", "glob": "x*"})
    assert again.latestOffset() == {path: 8}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_streamed_fold_equals_the_batch_fold(spark, tmp_path, rocks):
    rng = random.Random(2)
    rows = []
    for n in range(300):
        some = lambda v: v if rng.random() < 0.5 else None
        rows.append((f"s{rng.randrange(12)}", rng.choice(["claude", "codex"]), some(f"/w{n}"), some(f"b{n}"), some(f"said {n}"), some(f"f{n}"), some(n % 3), some(1000 + rng.randrange(500)), some(2000 + rng.randrange(500)), n))
    rng.shuffle(rows)
    schema = "session_id string, source string, cwd string, git_branch string, last_assistant_text string, raw_path string, parser_version int, first_activity_ms long, last_activity_ms long, seq long"
    df = spark.createDataFrame(rows, schema)
    kept = Store(spark, str(tmp_path / "store"))
    for k in range(4):  # each part of the files is a run of its own, with the state of the runs before
        df.where(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.watch_sessions(kept, source, str(tmp_path / "ck")).awaitTermination()
    columns = ["session_id", "source", *folds.LAST, "first_activity_ms", "last_activity_ms"]
    want = sorted(map(repr, store.fold_sessions(df).select(*columns).collect()))
    assert sorted(map(repr, ingest.streamed_sessions(kept).select(*columns).collect())) == want and len(want) > 15
    last = kept.read("session_parts", folds.PARTS)
    assert sorted(map(repr, folds.fold_parts(folds.fold_parts(last.where("cwd_seq % 2 = 0 or cwd_seq is null")).unionByName(last)).select(*columns).collect())) == want
    # With a state that lives no longer than a moment, parts of parts come out, and fold to the same.
    short = Store(spark, str(tmp_path / "short"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.watch_sessions(short, source, str(tmp_path / "ck2"), idle_ms=1).awaitTermination()
    assert sorted(map(repr, ingest.streamed_sessions(short).select(*columns).collect())) == want
    parts = short.read("session_parts", folds.PARTS)
    assert parts.groupBy("session_id", "source").agg(F.count_distinct("first_activity_ms")).where("`count(DISTINCT first_activity_ms)` > 1").count() > 0


def test_repeats_leave_the_stream(spark, tmp_path):
    rows = spark.createDataFrame([("claude", n % 5, f"p{n % 5}", n) for n in range(40)], "source string, timestamp_ms long, prompt string, n int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.first_seen(stream, ("source", "timestamp_ms", "prompt")).writeStream.format("memory").queryName("seen_once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.prompt for r in spark.table("seen_once").collect()) == [f"p{n}" for n in range(5)]
