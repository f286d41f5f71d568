import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from annalist.functions import fts
from annalist.functions import scalars as S
from annalist.operators import links, search, sessions, tags
from annalist.schemas import check_source


def random_condition(r, words):
    """A query in the words of SQLite's full-text extension, and the same as a function of the columns."""

    def term():
        kind, w = r.randrange(6), r.choice(words)
        if kind == 0:
            v = r.choice(words)
            return f'"{w} {v}"', lambda f: f.has(f"{w} {v}")
        if kind == 1:
            return w[:2] + "*", lambda f: f.has(w[:2], prefix=True)
        if kind == 2:
            c = r.choice(["prompt", "project"])
            return f"{c} : {w}", lambda f: f.only(c).has(w)
        if kind == 3:
            v, n = r.choice(words), r.randrange(4)
            return f"NEAR({w} {v}, {n})", lambda f: f.near([w, v], n)
        if kind == 4:
            return "^" + w, lambda f: f.has(w, first=True)
        return w, lambda f: f.has(w)

    text, build = term()
    for _ in range(r.randrange(3)):
        how, (other, more) = r.choice(["AND", "OR", "NOT"]), term()
        text, build = f"({text}) {how} ({other})", {"AND": lambda f, a=build, b=more: a(f) & b(f), "OR": lambda f, a=build, b=more: a(f) | b(f), "NOT": lambda f, a=build, b=more: a(f) & ~b(f)}[how]
    return text, build


def test_full_text_equals_fts5(spark):
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma", "café", "naïve", "delta-x", "it's", "Ünder", "日本", "x_y", "a1", "İstanbul", "ŁÓDŹ"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 9))) + r.choice(["", ".", "!"]), r.choice(["/w/alpha", "/w/beta/pkg", None])) for i in range(150)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(prompt, project)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("insert into t(rowid, prompt, project) values (?, ?, ?)", rows)
    plain = spark.createDataFrame(rows, "id long, prompt string, project string").cache()
    words = ["alpha", "beta", "gamma", "cafe", "naive", "delta", "under", "x", "y", "a1", "it"]
    queries = [random_condition(r, words) for _ in range(60)]
    want = [{x[0] for x in db.execute("select rowid from t where t match ?", (q,))} for q, _ in queries]
    assert sum(map(bool, want)) > 35
    for df in (plain, fts.with_tokens(plain, "prompt", "project")):  # by patterns, and by kept tokens
        f = fts.fields(df, "prompt", "project")
        assert bool(f.kept) == (df is not plain)
        flags = df.select("id", *(build(f).alias(f"q{i}") for i, (_, build) in enumerate(queries))).collect()
        for i, (q, _) in enumerate(queries):
            assert {x.id for x in flags if x[f"q{i}"]} == want[i], q


def test_terms(spark):
    df = spark.createDataFrame([(1, 'say "so" to alpha-beta'), (2, "alphabet soup"), (3, None)], "id long, prompt string")
    f = fts.fields(df, "prompt")

    def found(*terms):
        return [r.id for r in df.where(f.all_of(list(terms))).orderBy("id").collect()]

    assert found("alpha") == [1] and found("alpha*") == [1, 2] and found("alpha*", "-soup") == [1] and found("-alpha") == [] and found("alpha-beta") == [1] and found('"so to"') == [1]
    assert found("alpha", "--") == [1] and found("--") == [] and found() == [] and found('say"so') == [1]
    with pytest.raises(ValueError, match="no such column"):
        f.only("nope")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_scalars(spark):
    for text, want in [("cp /home/ines/x.txt /HOME/o-o/y", "cp /home/~/x.txt /HOME/~/y"), (r"D:\Users\Ana Li\notes", r"D:\Users\~\notes"), ("/users/zed", "/users/~"), ("/srv/homes/kept", "/srv/homes/kept")]:
        assert one(spark, S.home_as_tilde(F.col("c")), c=text) == want
    for ms, want in [(0, "1970-01-01T00:00:00.000Z"), (-1, "1969-12-31T23:59:59.999Z"), (1_709_251_199_007, "2024-02-29T23:59:59.007Z")]:
        assert one(spark, S.iso_time(F.col("c")), c=ms) == want
    for text, want in [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T01:00:00.5+01:00", 1704067200500), ("2024-01-01T00:00:00", None), ("junk", None), ("2024-13-01T00:00:00Z", None)]:
        assert one(spark, S.millis_of_iso(F.col("c")), c=text) == want
    assert one(spark, S.millis_of_date(F.col("c")), c="2024-01-01") == 1704067200000
    assert one(spark, S.tag_name(F.col("c")), c=" Big \t Bug\n") == "big bug"
    assert one(spark, S.shell_quoted(F.col("c")), c="it's") == "'it'\\''s'" and one(spark, S.shell_quoted(F.col("c")), c="a/b.c") == "a/b.c"
    assert one(spark, S.without_credentials(F.col("c")), c="https://u:p@h/x@y") == "https://h/x@y" and one(spark, S.without_credentials(F.col("c")), c="https://h/x@y") == "https://h/x@y"
    assert one(spark, S.percent_decoded(F.col("c")), c="a%20b+c") == "a b+c" and one(spark, S.percent_decoded(F.col("c")), c="a%zz%41%c3%a9%") == "a%zzAé%" and one(spark, S.percent_decoded(F.col("c")), c="%ff") is None
    assert one(spark, S.without_query_tag(F.col("c")), c=" <user_query>\nhi\n</user_query> ") == "hi"
    assert one(spark, S.human_seconds(F.col("c")), c=5399) == "89m" and one(spark, S.human_bytes(F.col("c")), c=1536) == "1.5 KB"
    assert one(spark, S.redacted(F.col("c")), c="x  sk-abc123\n y") == "x [REDACTED] y"
    assert one(spark, S.safe_cell(F.col("c")), c="a\x07b" + "c" * 70) == "ab" + "c" * 62 + "…"
    assert one(spark, S.unfenced_json(F.col("c")), c='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, S.tool_target(F.lit("Grep"), F.col("c")), c='{"path":"/p","pattern":"x"}') == "x"
    assert list(one(spark, S.patch_counts(F.col("c")), c="--- a\n+++ b\n+x\n-y\n+z")) == [2, 1]
    for a, b, want in [("/r/src/a.py", "src/a.py", True), ("a.py", "/x/a.py", True), ("ba.py", "a.py", False), ("src\\a.py", "src/a.py", True), ("./a.py", "a.py", True), ("/a/b/", "b", True), ("", "a", False)]:
        df = spark.createDataFrame([(a, b)], "a string, b string")
        assert df.select(S.paths_overlap(F.col("a"), F.col("b"))).first()[0] is want
    assert one(spark, S.resume_command(F.lit("cursor"), F.lit("s 1"), F.col("c")), c="/p") == "cd /p && cursor-agent --resume='s 1'"
    assert one(spark, S.resume_command(F.lit("relay"), F.lit("s"), F.col("c")), c="/p") is None
    assert one(spark, S.within(F.col("c"), "/w/app/"), c="/w/app/x") and not one(spark, S.within(F.col("c"), "/w/app"), c="/w/apple") and one(spark, S.within(F.col("c"), "/"), c="/any")
    assert one(spark, S.like_ascii(F.col("c"), "P_T\\"), c="/put\\x")
    with pytest.raises(ValueError, match="unknown source"):
        check_source("vim")
    m = F.create_map(*(F.lit(x) for k in ("z", "trajectory_rowid", "a", "b", "history_id", "c", "d", "e") for x in (k, len(k))))
    assert one(spark, S.cursor_text(m), c="") == "history_id=10 trajectory_rowid=16 a=1 b=1 c=1 d=1 (+2 more)" and one(spark, S.cursor_text(F.create_map().cast("map<string,int>")), c="") == "-"
    assert one(spark, S.display_name(F.lit(""), F.lit(None).cast("string"), F.col("c")), c="id") == "id" and one(spark, S.status_cell(F.col("c")), c="stale") == "STALE"
    assert one(spark, S.entry_text(F.lit(7), F.lit(60_000), F.lit("claude"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("c"), 3), c="a\nbcd") == "#7  1970-01-01 00:01  (claude)\n  session_id: (none)\n  a b..."
    d = F.array(F.struct(F.lit("q").alias("question"), F.lit("c").alias("chosen"), F.lit("r").alias("reasoning"), F.array(F.lit("x"), F.lit("y")).alias("alternatives")))
    none = F.lit(None).cast("string")
    row = S.trajectory_text_row(F.lit("t"), F.lit(0), F.lit("p"), none, none, F.lit("d"), d, F.col("c"), none, F.array(F.lit("l")), F.lit(0.5))
    assert one(spark, row, c="s") == "trajectory_id: t\n1970-01-01 00:00  [p]\ntask: (untitled task)\ndescription: d\ndecisions:\n1. q\n   chosen: c\n   reasoning: r alternatives: x, y\nretrospective:\nsummary: s\nlearnings: l\nconfidence: 0.5"


HISTORY = "id long, source string, session_id string, project string, prompt string, timestamp_ms long"


def test_context_show_pack_and_search(spark):
    rows = [(1, "claude", "a", "/p", "fix the auth bug", 0), (2, "claude", "a", "/p", "and café", 600_000), (3, "codex", "b", "/q", "auth parity-check", 60_000), (4, "relay", None, None, "bug", 120_000), (5, "codex", "b", "/q", "far", 10**9)]
    h = spark.createDataFrame(rows, HISTORY)
    assert [(r.id, r.relation) for r in search.context(h, 1, 5).collect()] == [(3, "nearby"), (4, "nearby"), (1, "session"), (2, "session")]
    assert [r.id for r in search.context(h, 4, 1).collect()] == [3, 4]
    shown = search.show(h, 1).first()
    assert shown.session_size == 2 and shown.resume == "cd /p && claude --resume a"
    assert [r.id for r in search.search(h, "auth -parity-check").collect()] == [1] and [r.id for r in search.search(h, ["parity-check"]).collect()] == [3]
    assert [r.id for r in search.search(h, "", 2).collect()] == [5, 2] and search.resume(h, "bug").count() == 0
    assert search.pack(h, "auth", tokens=1).orderBy("n").first().text == "auth..."
    assert [r.id for r in search.search_substring(h, "PARITY-").collect()] == [3]
    assert sessions.stats(h).first().total == 5 and sessions.stats(h, scope="/q/").first().total == 2
    assert search.context(h, 99).count() == 0
    with pytest.raises(KeyError, match="No entry"):
        search.known_entry(h, 99)


def test_tag_writes(spark):
    t = spark.createDataFrame([(1, "bug", "Bug", "red", 1, 1)], "id long, name string, display_name string, color string, created_ms long, updated_ms long")
    both = {r.name: r for r in tags.ensure_tag(tags.ensure_tag(t, "New Tag", None, 5), " BUG", None, 9).collect()}
    assert both["bug"].color == "red" and both["bug"].updated_ms == 9 and both["new tag"].id == 2
    with pytest.raises(ValueError, match="name"):
        tags.ensure_tag(t, "  ", None, 1)


def test_commit_links(spark):
    s = spark.createDataFrame([("s", "claude", "/r", "main", 1_000_000, 1_060_000), ("far", "claude", "/r", "main", 0, 10**9)], "session_id string, source string, cwd string, git_branch string, first_activity_ms long, last_activity_ms long")
    c = spark.createDataFrame([("c1", 1_030_000, "/r", "main")], "commit_sha string, commit_ms long, repo string, branch string")
    files = links.overlaps(spark.createDataFrame([("c1", "src/a.py"), ("c1", "b.py")], "commit_sha string, file_path string"), spark.createDataFrame([("s", "claude", "/r/src/a.py")], "session_id string, source string, file_path string"))
    best = links.best_links(links.best_candidates(s, c, files)).first()
    assert (best.session_id, best.overlap, best.time_distance_ms) == ("s", 1, 0) and best.confidence == pytest.approx(0.98)
    elsewhere = spark.createDataFrame([("b", "codex", "/x", "main", 1_000_000, 1_060_000), ("in", "codex", "/r/deep/er", "other", 1_000_000, 1_060_000), ("no", "codex", "/rr", "dev", 1_000_000, 1_060_000), ("un", "codex", None, None, 1_000_000, 1_060_000)], s.schema)
    assert links.best_candidates(s.unionByName(elsewhere), c, files).first().session_id == "s" and links.best_candidates(elsewhere.where("session_id in ('no', 'un')"), c).count() == 0
    changes = spark.createDataFrame([("c1", "src/a.py", 3, 1), ("c1", "bin", None, None)], "commit_sha string, file_path string, lines_added long, lines_removed long")
    rows = links.link_rows(links.best_candidates(s, c, files), c, changes, "auto", 77)
    r = rows.first()
    told = json.loads(r.evidence_json)
    assert json.loads(r.files_json) == ["bin", "src/a.py"] and told["candidate"]["file_overlap"] == 1 and told["candidate"]["cwd_match"] and told["commit_time_ms"] == 1_030_000
    assert json.loads(r.numstat_json) == [{"path": "bin", "additions": None, "deletions": None}, {"path": "src/a.py", "additions": 3, "deletions": 1}]
    out = json.loads(links.exported_links(rows, repo="/R").first().value)
    assert out["files_json"] == ["bin", "src/a.py"] and out["evidence_json"]["repo_path"] == "/r" and out["note_ref"] is None and links.exported_links(rows, source="grok").count() == 0
    assert links.numstat(spark.createDataFrame([("c", "1\t2\tx"), ("c", "-\t-\tbin")], "commit_sha string, value string")).where("lines_added is null").count() == 1
