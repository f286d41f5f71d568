"""Tables of SQLite files as DataFrames, and DataFrames as folders of SQLite files.

spark.dataSource.register(SqliteSource); spark.read.format("sqlite").schema(...).option("path", p).option("table", t).load().
The path is a file, or a folder of .db files that hold the table in parts; tasks must reach it (a shared folder). A table is
read in ranges of its row ids, one a task; columns that the table lacks are null, so older files can be read by a newer
schema. A DataFrame is written by its tasks, a file a partition, under names that count only once the job commits.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from annalist.functions import scalars as S
from annalist.sources.logs import EXPORT

ROWS_A_TASK = 100_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _name(text: str) -> str:
    if not re.fullmatch(r"\w+", text):
        raise ValueError(f"not a name: {text!r}")
    return f'"{text}"'


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, _name(table), columns

    def partitions(self):
        files = sorted(f"{self.path}/{f}" for f in os.listdir(self.path) if f.endswith(".db")) if os.path.isdir(self.path) else [self.path]
        out = []
        for path in files:
            with _open(path) as db:
                low, high = db.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone()
            if low is not None:
                out += [Range(path, a, min(a + ROWS_A_TASK - 1, high)) for a in range(low, high + 1, ROWS_A_TASK)]
        return out or [Range(files[0], 1, 0)] if files else []

    def read(self, part):
        with _open(part.path) as db:
            there = {r[1] for r in db.execute(f"pragma table_info({self.table})")}
            wanted = ", ".join(_name(c) if c in there else "null" for c in self.columns)
            yield from db.execute(f"select {wanted} from {self.table} where rowid between ? and ?", (part.low, part.high))


@dataclass
class Part(WriterCommitMessage):
    hidden: str
    name: str
    rows: int


class SqliteWriter(DataSourceWriter):
    """Each task writes a file of its own beside the final name; the commit renames the files of the attempts that count."""

    def __init__(self, folder: str, create: str, table: str, columns: list[str]):
        self.folder, self.create = folder, create
        self.insert = f"insert or ignore into {_name(table)} ({', '.join(map(_name, columns))}) values ({', '.join('?' * len(columns))})"

    def write(self, rows) -> Part:
        n = TaskContext.get().partitionId()
        hidden = f"{self.folder}/.part-{n:05}-{uuid.uuid4().hex}"
        db = sqlite3.connect(hidden)
        with db:
            db.execute(self.create)
            done = db.executemany(self.insert, (tuple(r) for r in rows)).rowcount
        db.close()
        return Part(hidden, f"{self.folder}/part-{n:05}.db", max(0, done))

    def commit(self, messages) -> None:
        for m in messages:
            if m.rows:
                os.replace(m.hidden, m.name)
            else:
                os.remove(m.hidden)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.hidden):
                os.remove(m.hidden)


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        raise ValueError("give a schema")

    def reader(self, schema):
        return SqliteReader(self.options["path"], self.options["table"], schema.fieldNames())

    def writer(self, schema, overwrite):
        return SqliteWriter(self.options["path"], self.options["create"], self.options["table"], schema.fieldNames())


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("table", table).load(path)


def opencode(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(session, message, part) of an OpenCode database, for logs.opencode_prompts."""
    session = read_table(spark, path, "session", "id string, directory string, time_created long")
    message = read_table(spark, path, "message", "id string, session_id string, time_created long, data string")
    part = read_table(spark, path, "part", "id string, message_id string, session_id string, time_created long, data string")
    return session, message, part


def imported_history(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of another store's file; a missing hash is computed."""
    rows = read_table(spark, path, "history", "source string, session_id string, project string, prompt string, prompt_hash string, timestamp_ms long")
    return rows.where(F.coalesce("prompt", F.lit("")) != "").withColumn("prompt_hash", F.coalesce("prompt_hash", S.prompt_hash(F.col("prompt")))).select(*EXPORT)


_HISTORY = "create table history (id integer primary key, source text not null, session_id text, project text, prompt text not null, prompt_hash text, timestamp_ms integer not null, unique (source, timestamp_ms, prompt))"


def export_history(history: DataFrame, folder: str) -> None:
    """The prompts as SQLite files of a new folder, in order of time from file to file; tasks write them, the driver sees names."""
    os.makedirs(folder)
    history.sparkSession.dataSource.register(SqliteSource)
    rows = history.withColumn("prompt_hash", S.prompt_hash(F.col("prompt"))).repartitionByRange("timestamp_ms", "id").sortWithinPartitions("timestamp_ms", "id").select(*EXPORT)
    rows.write.format("sqlite").option("table", "history").option("create", _HISTORY).mode("append").save(folder)
