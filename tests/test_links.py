import random

from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators import links

HOUR = links.HOUR_MS
SESSIONS = "session_id string, source string, cwd string, git_branch string, first_activity_ms long, last_activity_ms long"
COMMITS = "commit_sha string, commit_ms long, repo string, branch string"


def plain(sessions, commits, shared):
    """commit_sha -> (confidence, session_id, overlap, distance), by all pairs."""
    out = {}
    for sha, t, repo, branch in commits:
        best = None
        for name, source, cwd, own, first, last in sessions:
            at = last if last is not None else first if first is not None else 0
            begin = first if first is not None else at
            if not t - 36 * HOUR <= at <= t + 6 * HOUR:
                continue
            place = cwd is not None and repo is not None and (cwd == repo or cwd.startswith(repo + "/"))
            same = own is not None and own == branch
            if not (place or same):
                continue
            far = max(begin - t, t - at, 0)
            n = shared.get((sha, name, source), 0)
            sure = 45 + 20 * place + 20 * same + (10 if far == 0 else 5 if far <= 2 * HOUR else 0) + 5 * (n > 0)
            key = (min(98, sure), at, source, name)
            if best is None or key > best[0]:
                best = (key, n, far)
        if best:
            out[sha] = (best[0][0], best[0][3], best[1], best[2])
    return out


def test_best_session_equals_all_pairs(spark):
    rng = random.Random(7)
    places, branches = ["/r", "/r/a", "/r/a/b", "/ra", "/", "/x y/z", None], ["main", "main", "main", "dev", None]
    base = 1_700_000_000_000
    sessions = []
    for k in range(700):
        begin = base + rng.randrange(200 * HOUR)
        long = rng.choice([0, rng.randrange(HOUR), rng.randrange(5 * HOUR), 4 * HOUR, 6 * HOUR, rng.randrange(60 * HOUR), -HOUR])
        first, last = rng.choice([(begin, begin + long)] * 8 + [(None, begin), (begin, None)])
        sessions.append((f"s{k}", rng.choice(["claude", "codex"]), rng.choice(places), rng.choice(branches), first, last))
    sessions += [("none", "claude", "/r", "main", None, None), ("tie", "claude", "/r", "main", base, base + HOUR), ("tie", "codex", "/r", "main", base, base + HOUR)]
    ends = [x for s in sessions for x in s[4:] if x is not None]
    commits = [(f"c{k}", rng.choice([base + rng.randrange(220 * HOUR), rng.choice(ends) + rng.choice([0, -6 * HOUR, 2 * HOUR, -2 * HOUR, 36 * HOUR, 1])]), rng.choice(places), rng.choice(branches)) for k in range(900)]
    commits.append(("early", 5, "/r", "main"))
    shared = {(rng.choice(commits)[0], *rng.choice(sessions)[:2]): rng.randrange(1, 4) for _ in range(3000)}
    s, c = spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(commits, COMMITS)
    overlap = spark.createDataFrame([(*k, v) for k, v in shared.items()], "commit_sha string, session_id string, source string, overlap long")
    for own, more in ((None, {}), (overlap, shared)):
        best = links.best_links(links.best_candidates(s, c, own))
        got = {r.commit_sha: (round(100 * r.confidence), r.session_id, r.overlap, r.time_distance_ms) for r in best.collect()}
        want = plain(sessions, commits, more)
        assert got == want and len(want) > 500
    assert "early" in want


def test_a_busy_branch_makes_few_pairs(spark):
    """All sessions and commits on one branch and in one hour: pairs grow with the commits alone."""
    s = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("claude").alias("source"), F.lit("/r").alias("cwd"), F.lit("main").alias("git_branch"), (F.col("id") * 1000).alias("first_activity_ms"), (F.col("id") * 1000 + 60_000).alias("last_activity_ms"))
    c = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("commit_sha"), (F.col("id") * 1500).alias("commit_ms"), F.lit("/r").alias("repo"), F.lit("main").alias("branch"))
    met = links.near_best(links.numbered_sessions(s), c)
    assert 2000 < met.distinct().count() <= 10 * 2000
    best = links.best_candidates(s, c)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert best.count() == 2000 and "SortAggregate" not in plan


def test_overlapping_paths_equal_all_pairs(spark):
    rng = random.Random(9)
    names = ["a.py", "b", "src", "x y", "README.md", "é", "."]
    paths = ["/".join(rng.choices(names, k=rng.randrange(1, 5))) for _ in range(150)] + ["/README.md", "README.md/", "", "/", "src\\a.py", "//b//b"]
    mine = [(f"c{k % 20}", p) for k, p in enumerate(paths)]
    theirs = [(f"s{k % 9}", "claude", p) for k, p in enumerate(reversed(paths))]
    a, b = spark.createDataFrame(mine, "commit_sha string, file_path string"), spark.createDataFrame(theirs, "session_id string, source string, file_path string")
    all_pairs = a.crossJoin(b.withColumnRenamed("file_path", "other")).where(S.paths_overlap(F.col("file_path"), F.col("other")))
    want = {(r.commit_sha, r.session_id): r.n for r in all_pairs.groupBy("commit_sha", "session_id").agg(F.count_distinct("file_path").alias("n")).collect()}
    assert {(r.commit_sha, r.session_id): r.overlap for r in links.overlaps(a, b).collect()} == want and len(want) > 50


def test_a_busy_day_is_dealt_by_minutes(spark):
    """All commits on one branch and day: no group of the window, and no task, holds a share of them that grows with them."""
    s = spark.range(300).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("claude").alias("source"), F.lit("/r").alias("cwd"), F.lit("main").alias("git_branch"), (F.col("id") * 280_000).alias("first_activity_ms"), (F.col("id") * 280_000 + 60_000).alias("last_activity_ms"))
    c = spark.range(200_000).select(F.concat(F.lit("c"), "id").alias("commit_sha"), (F.col("id") * 432).alias("commit_ms"), F.lit("/r").alias("repo"), F.lit("main").alias("branch"))
    met = links.near_best(links.numbered_sessions(s), c)
    sizes = [r["count"] for r in met.select("commit_sha").distinct().groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) * 3 <= 1.2 * links.ROWS
    assert links.best_candidates(s, c).count() == 200_000
    plan = met._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(kind" in plan and ", slot" in plan.split("windowspecdefinition(kind")[1].split(" ASC")[0]
