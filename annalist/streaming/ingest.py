"""Incremental ingestion: Structured Streaming over files as they come, and runs over files that grow.

A file source sees a file once, so files that grow are read by byte ranges: the store's manifest keeps how many bytes of
each file were read, and moves forward only. Files that are read whole have a stamp of time and size instead. Rows are
added before the manifest is, and added rows are known by their keys: a run that breaks off is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.store import Store
from annalist.schemas import KEYS, SESSIONS
from annalist.sources import growing, logs
from annalist.streaming import folds

MANIFEST = "source string, path string, bytes long, stamp string"


def stamp(modified, size):
    return F.concat(F.unix_micros(modified).cast("string"), F.lit(":"), size.cast("string"))


def manifest(store: Store, source: str) -> DataFrame:
    """path, bytes, stamp: how far each file of a source was read, and how it was when it was read whole."""
    rows = store.read("manifest", MANIFEST).where(F.col("source") == source)
    return rows.groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("stamp").alias("stamp"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, stamp) that the manifest doesn't have as they are: an anti join."""
    return files.join(known.select("path", "stamp"), ["path", "stamp"], "left_anti")


def needing_repair(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions whose transcript was read but that have no events: they are read again."""
    return sessions.join(events.select("source", "session_id"), ["source", "session_id"], "left_anti")


def sync_lines(store: Store, source: str, folder: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*.jsonl", chunk_bytes: int = 256 << 20) -> dict[str, int]:
    """Reads what is new in a source's growing files and adds its prompts, `chunk_bytes` of each file at a time.

    Returns the numbers of prompts added, lines read and lines that aren't JSON.
    """
    told = {"added": 0, "lines": 0, "bad": 0}
    while True:
        lines = growing.new_lines(store.spark, folder, manifest(store, source), glob, chunk_bytes).persist()
        seen = growing.progress(lines).select(F.lit(source).alias("source"), "path", "bytes", F.lit(None).cast("string").alias("stamp"))
        count = lines.where("value <> ''").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("bad")).first()
        if seen.isEmpty():
            lines.unpersist()
            return told
        told["added"] += store.add_history(parse(lines.where("value <> ''")))
        told["lines"], told["bad"] = told["lines"] + count.n, told["bad"] + count.bad
        store.append("manifest", seen)
        lines.unpersist()


def sync_sessions(store: Store, folder: str, events: DataFrame, now_ms: int, source: str = "claude") -> int:
    """Summaries of the transcripts that are new, have changed, or have no events yet. Returns how many files were read."""
    files = growing.files(store.spark, folder).withColumn("stamp", stamp(F.col("modified"), F.col("length"))).select("path", "stamp")
    known = manifest(store, f"{source}-sessions")
    lacking = needing_repair(store.sessions().where(F.col("source") == source), events).select(F.col("raw_path").alias("path"))
    todo = changed_files(files, known).unionByName(files.join(lacking, "path", "left_semi")).distinct().persist()
    n = todo.count()
    if n:
        paths = [r.path for r in todo.select("path").collect()]  # names of the changed files: they alone are opened
        store.add_sessions(logs.claude_sessions(logs.json_lines(store.spark, paths)), now_ms)
        store.append("manifest", todo.select(F.lit(f"{source}-sessions").alias("source"), "path", F.lit(None).cast("long").alias("bytes"), "stamp"))
    todo.unpersist()
    return n


def sync(steps: Iterable[tuple[str, Callable[[], object]]]) -> dict[str, object]:
    """Runs each source's step; one that fails doesn't stop the others, all failing is an error."""
    done: dict[str, object] = {}
    for name, step in steps:
        try:
            done[name] = step()
        except Exception as e:  # noqa: BLE001  the source is reported with its error
            done[name] = e
    if done and all(isinstance(x, Exception) for x in done.values()):
        raise RuntimeError("all sources failed: " + "; ".join(f"{k}: {v}" for k, v in done.items()))
    return done


def watch_folder(spark: SparkSession, folder: str, add: Callable[[DataFrame], object], checkpoint: str, every: str | None = None):
    """A stream over new files of a folder: add gets each micro-batch's lines (path, modified, line, value, v) once.

    add is a store's: lambda lines: store.add_history(logs.claude_prompts(lines)), or sessions folded by add_sessions.
    every: a trigger like '60 seconds'; None takes what is there and ends.
    """
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    lines = lines.where("value <> ''").withColumn("v", F.try_parse_json("value"))

    def each(batch, _):
        add(batch)

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_lines(store: Store, source: str, folder: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, glob: str = "*.jsonl", every: str | None = None, within: str = "1 hour", range_bytes: int = growing.RANGE_BYTES):
    """A stream over files that grow: each line's prompt is added to the store once, also after a restart.

    The checkpoint keeps the bytes of each file. Keys that came within the last hour are dropped by the stream's state, so that
    the store is asked about new ones; a batch that is run again finds its rows there. A null part of a key makes a row new.
    """
    rows = parse(growing.stream_lines(store.spark, folder, glob, range_bytes).where("value <> ''")).where(F.col("source") == source)
    whole = rows.where(" and ".join(f"{k} is not null" for k in KEYS["history"]))
    writer = folds.first_seen(whole, KEYS["history"], within).writeStream.foreachBatch(lambda batch, _: store.add_history(batch) and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_sessions(store: Store, rows: DataFrame, checkpoint: str, idle_ms: int = 6 * 3_600_000, every: str | None = None):
    """A stream of session rows folded with state; each batch adds the sessions that it touched as parts to the store."""
    writer = folds.session_parts(rows, idle_ms).writeStream.outputMode("update").foreachBatch(lambda batch, _: store.append("session_parts", batch))
    writer = writer.option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    # State that may run out asks for batches without data for ever; a query that takes what is there doesn't need them.
    conf, name = store.spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    old = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()  # it keeps the settings that it starts with
    finally:
        conf.set(name, old)


def streamed_sessions(store: Store) -> DataFrame:
    """Every session's summary, folded from the parts that streams have added."""
    return folds.fold_parts(store.read("session_parts", folds.PARTS)).select(*(c.split()[0] for c in SESSIONS.split(", ")))


def beats(spark: SparkSession, folder: str, schema: str, watermark: str = "1 day", window: str = "1 hour"):
    """Last record and number of records of each machine and window over a stream of event files (ts timestamp, machine_id).

    Windows that lie before the watermark are closed and leave the state, so it doesn't grow with time.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", watermark)
    out = rows.groupBy("machine_id", F.window("ts", window).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("records"))
    return out.select("machine_id", F.col("w.start").alias("start"), "last", "records")
