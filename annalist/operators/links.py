"""Commits linked to the sessions that may have made them, without making the pairs.

A session counts only if it was active around the commit and shares its folder or its branch; the surest wins, of equals
the one that was active last. Sessions get dense numbers in order of last activity, so the last active of any set is its
greatest number. For a key (branch, folder, or both) three sets can hold the best: all sessions of the time window, those
within two hours of the commit, and those that were active at it. Each greatest number is a running maximum over the key's
sessions in order of time, in which commits stand among them:
- the last session up to the window's end;
- for sessions of at most four hours (six), the last of those that had begun by two hours after the commit (by the commit):
  they can't outlast the window's end; for longer ones, the last up to the window's end: they had begun in time.
A key's time is cut into slices that get the greatest numbers of the slices before them, and a slice into slots that get
those of the slots before them, so a busy key is spread over tasks, and a task holds the commits and sessions of a key's
minute at once. A commit meets at most fifteen sessions, mostly three or four, and is scored with these exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators.store import numbered
from annalist.work import written

HOUR_MS = 3_600_000
BEFORE_MS, AFTER_MS, NEAR_MS = 36 * HOUR_MS, 6 * HOUR_MS, 2 * HOUR_MS
#: Events of a key are dealt by slices of time; those of a commit's window lie in its slice and SLICES before it.
SLICE_MS = 6 * HOUR_MS
SLICES = -(-(BEFORE_MS + AFTER_MS) // SLICE_MS)
#: Slices are cut into slots of this length, in which commits stand among sessions.
SLOT_MS = 60_000
#: Rows that one task sorts, about.
ROWS = 1 << 18
_BEST = ("latest", "near_short", "near_long", "at_short", "at_long")


def folders(cwd: Column) -> Column:
    """A folder and all above it, without the slash at the end."""
    parts = F.split(cwd, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def numbered_sessions(sessions: DataFrame) -> DataFrame:
    """sessions with at_ms, begin, and no: dense numbers in order of (at_ms, source, session_id); a written table."""
    at = F.coalesce("last_activity_ms", "first_activity_ms", F.lit(0))
    rows = sessions.withColumns({"at_ms": at, "begin": F.coalesce("first_activity_ms", at), "seq": F.struct(at.alias("at"), "source", "session_id")})
    return written(numbered(rows, 0).withColumnRenamed("id", "no").drop("seq"), "numbered-sessions")


def _keys(branch: Column, places: Column) -> Column:
    """Keys of a branch and of some folders, alone and together; what is null has none."""
    own = F.when(branch.isNotNull(), F.array(F.struct(F.lit("b").alias("kind"), branch.alias("branch"), F.lit("").alias("place"))))
    alone = F.transform(places, lambda p: F.struct(F.lit("p").alias("kind"), F.lit("").alias("branch"), p.alias("place")))
    both = F.transform(F.when(branch.isNotNull(), places), lambda p: F.struct(F.lit("x").alias("kind"), branch.alias("branch"), p.alias("place")))
    return F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<struct<kind: string, branch: string, place: string>>")) for x in (own, alone, both))))


def near_best(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """commit_sha, commit_ms, repo, branch, no: for each commit the numbered sessions that can be its best."""
    length, no, none = F.col("at_ms") - F.col("begin"), F.col("no"), F.lit(None).cast("long")

    def event(time, **best):
        return F.struct(time.alias("time"), *(best.get(b, none).cast("long").alias(b) for b in _BEST))

    by_end = event(F.col("at_ms") - AFTER_MS, latest=no, near_long=F.when(length > AFTER_MS - NEAR_MS, no), at_long=F.when(length > AFTER_MS, no))
    by_begin = [event(F.col("begin") - NEAR_MS, near_short=F.when(length <= AFTER_MS - NEAR_MS, no)), event(F.col("begin"), at_short=F.when(length <= AFTER_MS, no))]
    keyed = sessions.select("at_ms", "begin", "no", _keys(F.col("git_branch"), F.array_distinct(folders(F.col("cwd")))).alias("key"))
    slots = {"slice": F.floor(F.col("time") / SLICE_MS), "slot": F.floor(F.col("time") / SLOT_MS)}
    events = keyed.select("key", F.explode(F.array(by_end, *by_begin)).alias("e")).select("key.*", "e.*").withColumns(slots)
    own = commits.select(F.struct("commit_sha", "commit_ms", "repo", "branch").alias("commit"), _keys(F.col("branch"), F.when(F.col("repo").isNotNull(), F.array("repo"))).alias("key"))
    asked = own.select("key.*", F.col("commit.commit_ms").alias("time"), "commit").withColumns(slots)
    place = ["kind", "branch", "place"]
    by_slot = events.groupBy(*place, "slice", "slot").agg(*(F.max(b).alias(b) for b in _BEST))
    before = by_slot.groupBy(*place, "slice").agg(*(F.max(b).alias(b) for b in _BEST))
    before = before.withColumn("slice", F.explode(F.sequence(F.col("slice") + 1, F.col("slice") + SLICES))).withColumn("slot", F.col("slice") * (SLICE_MS // SLOT_MS) - 1)
    wanted = asked.select(*place, "slice", "slot").distinct().withColumn("wanted", F.lit(True))
    # A window holds a row per slot of a slice for sessions, one for commits, and SLICES.
    earlier = Window.partitionBy(*place, "slice").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    starts = by_slot.unionByName(before).unionByName(wanted, allowMissingColumns=True).withColumns({b: F.max(b).over(earlier) for b in _BEST})
    starts = starts.where("wanted").drop("wanted", "slice").withColumn("time", F.col("slot") * SLOT_MS)
    # Dealt by number, so that what a task holds doesn't grow with the tables; a commit has up to three rows, a key of a session three.
    tasks = -(-3 * (commits.count() + keyed.count()) // ROWS) or 1
    line = events.drop("slice").unionByName(starts).unionByName(asked.drop("slice"), allowMissingColumns=True).repartition(tasks, *place, "slot")
    so_far = Window.partitionBy(*place, "slot").orderBy("time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumns({b: F.max(b).over(so_far) for b in _BEST}).where("commit is not null")
    best = F.filter(F.array_distinct(F.array(*_BEST)), lambda x: x.isNotNull())
    found = met.select("commit.*", best.alias("nos")).repartition(tasks, "commit_sha")  # a commit's keys meet, also for distinct rows
    return found.select("commit_sha", "commit_ms", "repo", "branch", F.explode("nos").alias("no"))


def overlaps(commit_files: DataFrame, session_files: DataFrame) -> DataFrame:
    """commit_sha, session_id, source, overlap: how many files of the commit a session has edited, by path endings.

    Of two paths that overlap the shorter is an ending of the longer. So distinct paths meet by the hash of a whole path
    and of all endings of the other side's, and files join the few pairs of paths that remain; a name alone joins nothing
    that it doesn't overlap with.
    """

    def paths(files: DataFrame) -> DataFrame:
        whole = F.trim(F.replace("file_path", F.lit("\\"), F.lit("/")), F.lit("/"))
        return written(files.select("file_path").distinct().select("file_path", whole.alias("path")).where("path <> ''"), "paths")

    def endings(rows: DataFrame, name: str) -> DataFrame:
        parts = F.split("path", "/")
        ending = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.xxhash64(F.array_join(F.slice(parts, n, F.size(parts)), "/")))
        return rows.select(F.col("file_path").alias(name), F.explode(ending).alias("key"))

    mine, theirs = paths(commit_files), paths(session_files)

    def whole(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("file_path").alias(name), F.xxhash64("path").alias("key"))

    pairs = whole(mine, "a").join(endings(theirs, "b"), "key").unionByName(endings(mine, "a").join(whole(theirs, "b"), "key"))
    pairs = pairs.where(S.paths_overlap(F.col("a"), F.col("b"))).select("a", "b").distinct()
    left = commit_files.select("commit_sha", F.col("file_path").alias("a")).distinct()
    right = session_files.select("session_id", "source", F.col("file_path").alias("b")).distinct()
    return left.join(pairs, "a").join(right, "b").groupBy("commit_sha", "session_id", "source").agg(F.count_distinct("a").alias("overlap"))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs of a commit and a session (with overlap) with time_distance_ms and confidence; those of another time, or of another folder and branch, go."""
    cwd = F.coalesce((F.col("cwd") == F.col("repo")) | F.startswith("cwd", F.concat("repo", F.lit("/"))), F.lit(False))
    branch = F.coalesce(F.col("git_branch") == F.col("branch"), F.lit(False))
    distance = F.greatest(F.col("begin") - F.col("commit_ms"), F.col("commit_ms") - F.col("at_ms"), F.lit(0).cast("long"))
    around = F.col("at_ms").between(F.col("commit_ms") - BEFORE_MS, F.col("commit_ms") + AFTER_MS)
    out = pairs.where(around).withColumns({"cwd_match": cwd, "branch_match": branch, "time_distance_ms": distance}).where("cwd_match or branch_match")
    sure = F.lit(0.45) + F.when(F.col("cwd_match"), 0.20).otherwise(0.0) + F.when(F.col("branch_match"), 0.20).otherwise(0.0)
    sure = sure + F.when(F.col("time_distance_ms") == 0, 0.10).when(F.col("time_distance_ms") <= NEAR_MS, 0.05).otherwise(0.0) + F.when(F.col("overlap") > 0, 0.05).otherwise(0.0)
    return out.withColumn("confidence", F.round(F.least(F.lit(0.98), sure), 6))


_EVIDENCE = ("cwd", "git_branch", "first_activity_ms", "last_activity_ms", "cwd_match", "branch_match", "time_distance_ms")
_COMMIT = ("commit_sha", "commit_ms", "repo", "branch")


def best_candidates(sessions: DataFrame, commits: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """A row per commit that has one: the surest session, of equals the one that was active last, with what speaks for it.

    overlap: commit_sha, session_id, source, overlap; its pairs are looked at besides, since a shared file makes surer.
    Confidence and number are one long, of which the greatest is kept; evidence joins the one session that is left.
    """
    known = numbered_sessions(sessions)
    met = near_best(known, commits).distinct().join(known, "no")
    if overlap is None:
        met = met.withColumn("overlap", F.lit(0).cast("long"))
    else:
        more = overlap.join(commits.select(*_COMMIT), "commit_sha").join(known, ["session_id", "source"]).select(*_COMMIT, "no", "overlap", *(c for c in known.columns if c != "no"))
        met = met.join(overlap, ["commit_sha", "session_id", "source"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))).unionByName(more, allowMissingColumns=True)
    packed = F.shiftleft(F.round(F.col("confidence") * 1_000_000).cast("long"), 40).bitwiseOR(F.col("no"))
    best = scored(met).groupBy("commit_sha").agg(F.max(packed).alias("packed"))
    rows = best.select("commit_sha", F.col("packed").bitwiseAND((1 << 40) - 1).alias("no")).join(commits.select(*_COMMIT), "commit_sha").join(known, "no")
    rows = rows.withColumn("overlap", F.lit(0).cast("long")) if overlap is None else rows.join(overlap, ["commit_sha", "session_id", "source"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return scored(rows).select("commit_sha", "source", "session_id", "confidence", F.struct(*_EVIDENCE, F.col("overlap").alias("file_overlap")).alias("evidence"))


def best_links(best: DataFrame) -> DataFrame:
    e = F.col("evidence")
    return best.select("commit_sha", "source", "session_id", "confidence", e["file_overlap"].alias("overlap"), e["time_distance_ms"].alias("time_distance_ms"))


def link_rows(best: DataFrame, commits: DataFrame, changes: DataFrame, method: str, now_ms: int) -> DataFrame:
    """Rows of session_commit_links of the best candidates; changes: commit_sha, file_path, lines_added, lines_removed."""
    stat = F.struct("file_path", "lines_added", "lines_removed")
    files = changes.groupBy("commit_sha").agg(F.array_sort(F.collect_set(stat)).alias("all"))  # a commit's own files
    numstat = F.transform("all", lambda x: F.struct(x["file_path"].alias("path"), x["lines_added"].alias("additions"), x["lines_removed"].alias("deletions")))
    names = F.transform("all", lambda x: x["file_path"])
    remote = F.col("repo_remote") if "repo_remote" in commits.columns else F.lit(None).cast("string")
    rows = best.join(commits.select("commit_sha", "repo", "branch", "commit_ms", remote.alias("repo_remote")), "commit_sha").join(files, "commit_sha", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<file_path:string,lines_added:bigint,lines_removed:bigint>>)")))
    keep = {"ignoreNullFields": "false"}
    evidence = F.struct(F.col("repo").alias("repo_path"), "repo_remote", "branch", F.col("commit_ms").alias("commit_time_ms"), F.col("evidence").alias("candidate"), names.alias("files"), numstat.alias("numstat"))
    return rows.select(
        "source", "session_id", "repo", "branch", "commit_sha", F.lit(None).cast("string").alias("note_ref"), F.lit(method).alias("match_method"), "confidence",
        F.to_json(names).alias("files_json"), F.to_json(numstat, keep).alias("numstat_json"), F.to_json(evidence, keep).alias("evidence_json"), F.lit(now_ms).cast("long").alias("created_at_ms"),
    )


def exported_links(links: DataFrame, source: str | None = None, repo: str | None = None, since: str | None = None) -> DataFrame:
    """Links as lines of JSON in order of creation, their JSON texts as nested values (null if they aren't JSON)."""
    rows = links if source is None else links.where(F.col("source") == source)
    rows = rows if repo is None else rows.where(S.like_ascii(F.col("repo"), repo))
    rows = rows if since is None else rows.where(F.col("created_at_ms") >= S.millis_of_date(F.lit(since)))
    nested = [F.try_parse_json(c).alias(c) for c in ("files_json", "numstat_json", "evidence_json")]
    value = F.to_json(F.struct("source", "session_id", "repo", "branch", "commit_sha", "note_ref", "match_method", "confidence", *nested, "created_at_ms"), {"ignoreNullFields": "false"})
    return rows.select("created_at_ms", *(["id"] if "id" in links.columns else []), "commit_sha", value.alias("value")).orderBy("created_at_ms", *(["id"] if "id" in links.columns else []), "commit_sha").select("value")


def numstat(lines: DataFrame) -> DataFrame:
    """commit_sha, file_path, lines_added, lines_removed from lines of `added <tab> removed <tab> path`; - is null."""
    part = F.split("value", "\t")
    return lines.select("commit_sha", F.get(part, F.lit(2)).alias("file_path"), F.get(part, F.lit(0)).try_cast("long").alias("lines_added"), F.get(part, F.lit(1)).try_cast("long").alias("lines_removed")).where("file_path is not null")


def commit_scan(outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, names, changes) of what git printed for each commit; running git is left to the caller.

    outputs: commit_sha, root, time (seconds), branch, remote, names (a path a line), numstat (added, removed and path by
    tabs). A detached head has no branch; the remote loses its user and password; a time that isn't a number is an error.
    """

    def printed(c):
        return S.strip(F.coalesce(c, F.lit("")))

    seconds = printed("time").try_cast("long")
    at = F.when(seconds.isNull(), F.raise_error(F.concat(F.lit("no commit time of "), "commit_sha"))).otherwise(seconds * 1000)
    branch = F.nullif(F.nullif(printed("branch"), F.lit("HEAD")), F.lit(""))
    remote = S.without_credentials(F.nullif(printed("remote"), F.lit("")))
    commits = outputs.select("commit_sha", at.alias("commit_ms"), F.nullif(printed("root"), F.lit("")).alias("repo"), branch.alias("branch"), remote.alias("repo_remote"))
    names = outputs.select("commit_sha", F.explode(F.split("names", "\r?\n")).alias("file_path")).withColumn("file_path", S.strip(F.col("file_path"))).where("file_path <> ''")
    return commits, names, numstat(outputs.select("commit_sha", F.explode(F.split("numstat", "\r?\n")).alias("value")))
