"""Writes to the store as folds over keys, and the store itself: a folder of plain Parquet tables that only grow.

Rows carry seq, their order of arrival, since first and last would mean nothing after a shuffle. A table is appended to
by ordinary Spark writes; rows that a key has already aren't added (history), or all are added and folded when
read (sessions, manifest, cursors). Nothing is rewritten or pointed to, so a run that breaks off loses nothing and
may be run again. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.functions.fts import with_tokens
from annalist.operators.index import POSTINGS, files_of, postings, write_postings
from annalist.operators.search import search
from annalist.schemas import HISTORY, KEYS, SESSIONS
from annalist.work import written

STORED_HISTORY = f"{HISTORY}, prompt_tokens string, project_tokens string, day string, batch long"
BATCHES = "batch long, last long, state string"
SEARCHED = ("prompt", "project")


def last_value(c: str) -> Column:
    """The last value that isn't null: COALESCE(new, old) folded over arrivals."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))


def first_value(c: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))


def first_wins(rows: DataFrame, keys: tuple[str, ...] = KEYS["history"]) -> DataFrame:
    """The first row of each key, in order of seq: summed by key, so repeated rows meet in their tasks first."""
    others = [c for c in rows.columns if c not in keys and c != "seq"]
    out = rows.groupBy(*keys).agg(F.min(F.struct("seq", *others)).alias("first"))
    return out.select(*(F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in rows.columns))


def last_wins(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys and c != "seq"]
    out = rows.groupBy(*keys).agg(F.max(F.struct("seq", *others)).alias("last"))
    return out.select(*(F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in rows.columns))


def new_rows(rows: DataFrame, stored: DataFrame, keys: tuple[str, ...] = KEYS["history"]) -> DataFrame:
    """INSERT OR IGNORE: the first of each key that the store doesn't have; null keys are new each time."""
    fresh = first_wins(rows.where(_complete(keys)), keys).unionByName(rows.where(~_complete(keys)))
    return fresh.join(stored.select(*keys), list(keys), "left_anti").select(*rows.columns)


def _complete(keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def placed(rows: DataFrame) -> DataFrame:
    """rows in order of seq as a written table, with _place: the number of a row's range and its place in it.

    The table is written before its ranges are counted: ranges that are computed twice need not be cut alike.
    """
    return written(rows.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_place", F.monotonically_increasing_id()), "numbered")


def with_ids(table: DataFrame, after: int) -> DataFrame:
    """The rows of a placed table with dense ids that follow `after`; only the ranges' counts are gathered."""
    parts = table.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return table.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(starts), "_part").withColumn("id", F.lit(after) + F.col("_before") + nth).drop("_part", "_place", "_before")


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """rows with dense ids that follow `after` in order of seq."""
    return with_ids(placed(rows), after)


def fold_events(rows: DataFrame) -> DataFrame:
    return last_wins(rows, KEYS["session_events"])


def fold_tool_calls(rows: DataFrame) -> DataFrame:
    """Last row wins, but is_error stays unless a new one is given."""
    keys = KEYS["tool_calls"]
    others = [c for c in rows.columns if c not in (*keys, "seq", "is_error")]
    out = rows.groupBy(*keys).agg(F.max(F.struct("seq", *others)).alias("last"), last_value("is_error").alias("is_error"))
    return out.select(*(F.col(f"last.{c}").alias(c) if c in ("seq", *others) else F.col(c) for c in rows.columns))


def with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with is_error of their last result that says so (source, session_id, tool_use_id, is_error, seq)."""
    keys = list(KEYS["tool_calls"])
    last = results.where("is_error is not null").groupBy(*keys).agg(F.max_by("is_error", "seq").alias("_error"))
    return calls.join(last, keys, "left").withColumn("is_error", F.coalesce("_error", "is_error")).select(*calls.columns)


def fold_file_edits(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Edits from tool calls, then from their results: a result replaces the line counts, fills the patch and the rest
    where it has a value, and leaves message and time if the call has them."""
    keys = list(KEYS["file_edits"])
    edits = calls.groupBy(*keys).agg(
        *(F.max_by(c, "seq").alias(c) for c in ("message_id", "file_path", "tool_name", "ts_ms")), *(last_value(c).alias(c) for c in ("git_branch", "cwd"))
    )
    last = results.groupBy(*keys).agg(
        *(F.max_by(c, "seq").alias(f"r_{c}") for c in ("lines_added", "lines_removed")),
        *(last_value(c).alias(f"r_{c}") for c in ("file_path", "structured_patch_json", "user_modified", "git_branch", "cwd")),
        *(first_value(c).alias(f"r_{c}") for c in ("message_id", "ts_ms")),
    )
    out = edits.join(last, keys, "left")
    new = {c: F.coalesce(f"r_{c}", c) for c in ("file_path", "git_branch", "cwd")} | {c: F.coalesce(c, f"r_{c}") for c in ("message_id", "ts_ms")}
    new |= {c: F.col(f"r_{c}") for c in ("lines_added", "lines_removed", "structured_patch_json", "user_modified")}
    return out.select(*keys, "tool_name", *(x.alias(c) for c, x in new.items()))


def fold_sessions(rows: DataFrame) -> DataFrame:
    """A session's summary from all that was seen of it: last values that are there, least first and greatest last time."""
    return rows.groupBy("session_id", "source").agg(
        *(last_value(c).alias(c) for c in ("cwd", "git_branch", "last_assistant_text", "raw_path")),
        F.min("first_activity_ms").alias("first_activity_ms"), F.max("last_activity_ms").alias("last_activity_ms"), F.max_by("parser_version", "seq").alias("parser_version"),
    )


def mirrored_trajectories(history: DataFrame, trajectories: DataFrame, last_id: int) -> DataFrame:
    """history with the trajectories' own rows replaced by new ones, which get new ids."""
    kept = history.join(trajectories.select(F.lit("trajectory").alias("source"), F.col("id").alias("session_id")), ["source", "session_id"], "left_anti")
    rows = trajectories.select(
        F.lit("trajectory").alias("source"), F.col("id").alias("session_id"), F.col("project_id").alias("project"), F.col("search_text").alias("prompt"),
        S.prompt_hash(F.col("search_text")).alias("prompt_hash"), "timestamp_ms", F.lit(None).cast("string").alias("git_branch"), F.struct("timestamp_ms", "id").alias("seq"),
    ).where(F.coalesce("prompt", F.lit("")) != "")
    return kept.select(*history.columns).unionByName(numbered(rows, last_id).drop("seq").select(*history.columns))


def with_trajectories(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Trajectories with new rows over old ones of the same id (rowid stays with the id)."""
    return stored.join(fresh.select("id"), "id", "left_anti").select(*stored.columns).unionByName(last_wins(fresh, ("id",)).join(stored.select("id", "rowid"), "id", "left").select(*stored.columns))


def with_codex_map(history: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Codex prompts whose project or branch is null, filled from the rollout map."""
    known = rollouts.select(F.lit("codex").alias("source"), "session_id", F.col("cwd").alias("_cwd"), F.col("git_branch").alias("_branch"))
    out = history.join(known, ["source", "session_id"], "left")
    return out.withColumn("project", F.coalesce("project", "_cwd")).withColumn("git_branch", F.coalesce("git_branch", "_branch")).select(*history.columns)


class Store:
    """Parquet tables below a folder. History is laid out by day and batch, keeps the tokens of its texts beside them, and has
    postings that tell which of its files may hold a token."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def read(self, table: str, schema: str) -> DataFrame:
        """The table's rows as they were added; no rows before the first were."""
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, table: str, rows: DataFrame, *partition_by: str) -> None:
        rows.write.mode("append").partitionBy(*partition_by).parquet(self.path(table))

    def history(self) -> DataFrame:
        return self.read("history", STORED_HISTORY)

    def add_history(self, rows: DataFrame) -> int:
        """Adds prompts whose key the store doesn't have; the first of a key wins. Returns their number.

        Only the days that the rows touch are read, and only the new rows are written. Ids are taken before rows are
        written: a run that breaks off leaves a gap and no id twice.
        """
        rows = rows.withColumn("day", S.day(F.col("timestamp_ms")))
        touched = self.history().join(F.broadcast(rows.select("day").distinct()), "day", "left_semi")  # days: few
        fresh = placed(new_rows(rows, touched, KEYS["history"]))
        n = fresh.count()
        if n:
            last = self.read("batches", BATCHES).agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]  # two rows per batch
            columns = [c.split()[0] for c in HISTORY.split(", ")]
            added = with_ids(fresh, last).select(*columns, "day", F.lit(last + 1).cast("long").alias("batch"))
            self._mark(last + 1, last + n, "begun")
            self.append("history", with_tokens(added, "prompt", "project"), "day", "batch")
            self.index(last + 1)
        return n

    def _mark(self, batch: int, last: int | None, state: str) -> None:
        """Notes that a batch has taken the ids from its own number to last, or that its postings are written."""
        self.append("batches", self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(last).cast("long").alias("last"), F.lit(state).alias("state")).coalesce(1))

    def _batches(self) -> tuple[list[int], list[int]]:
        """Batches whose files the postings have, and those that they lack."""
        rows = self.read("batches", BATCHES).groupBy("batch").agg(F.max(F.col("state") == "indexed").alias("indexed")).orderBy("batch").collect()  # a row per batch
        return [r.batch for r in rows if r.indexed], [r.batch for r in rows if not r.indexed]

    def index(self, *batches: int) -> None:
        """Writes the postings of batches that lack them (all such, if none is named); their files alone are read."""
        for batch in batches or self._batches()[1]:
            below = F.regexp_extract("_metadata.file_path", r"day=[^/]*/batch=[^/]*/[^/]+$", 0)
            rows = self.history().where(F.col("batch") == batch).select("*", below.alias("file"))
            write_postings(postings(rows, *SEARCHED), self.path("postings"))
            self._mark(batch, None, "indexed")

    def matching(self, query) -> DataFrame:
        """The history without the files that the postings rule out for a query (terms, or a condition as for search).

        The names of files that stay go through the driver, which lists a table's files for any scan.
        """
        terms = query if callable(query) else [t for t in (query.split() if isinstance(query, str) else query) if t.strip()]
        found = None if not terms else files_of(self.read("postings", POSTINGS), terms, SEARCHED)
        if found is None:
            return self.history()
        known, unknown = self._batches()
        paths = [f"{self.path('history')}/{r.file}" for r in found.where(F.col("batch").isin(known)).collect()] if known else []
        out = self.spark.read.schema(STORED_HISTORY).option("basePath", self.path("history")).parquet(*paths) if paths else self.spark.createDataFrame([], STORED_HISTORY)
        return out.unionByName(self.history().where(F.col("batch").isin(unknown))) if unknown else out

    def search(self, query, limit: int = 20, **filters) -> DataFrame:
        """As search.search over the history, reading only files that may hold a match."""
        return search(self.matching(query), query, limit, **filters)

    def sessions(self) -> DataFrame:
        """Every session's summary, folded from all that was added."""
        return fold_sessions(self.read("sessions", f"{SESSIONS}, seq struct<at:long,path:string>")).select(*(c.split()[0] for c in SESSIONS.split(", ")))

    def add_sessions(self, rows: DataFrame, now_ms: int) -> None:
        self.append("sessions", rows.select(*(c.split()[0] for c in SESSIONS.split(", ")), F.struct(F.lit(now_ms).cast("long").alias("at"), F.col("raw_path").alias("path")).alias("seq")))

    def cursors(self) -> dict[str, int]:
        """The greatest value of each cursor that was ever saved."""
        return {r.name: r.value for r in self.read("cursors", "name string, value long").groupBy("name").agg(F.max("value").alias("value")).collect()}

    def save_cursors(self, cursors: dict[str, int]) -> None:
        """Cursors never go back: a smaller value is kept, but isn't read."""
        if cursors != {k: v for k, v in self.cursors().items() if k in cursors}:
            self.append("cursors", self.spark.createDataFrame(list(cursors.items()), "name string, value long").coalesce(1))
