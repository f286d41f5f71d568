import pytest
from pyspark.sql import functions as F

from annalist.operators import search, store
from annalist.operators.store import Store
from annalist.sources import logs

ROW = "source string, session_id string, project string, prompt string, prompt_hash string, timestamp_ms long, git_branch string, seq struct<n:long>"


@pytest.fixture
def defaults(spark):
    """The session's own number of partitions, which adaptive execution merges by what a branch carries."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.shuffle.partitions")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def prompts(spark, n, words=100):
    text = F.concat(F.lit("prompt "), F.col("id").cast("string"), F.repeat(F.lit(" abcd"), words))
    none = F.lit(None).cast("string")
    return spark.range(n).select(F.lit("claude").alias("source"), F.lit("s").alias("session_id"), none.alias("project"), text.alias("prompt"), none.alias("prompt_hash"), (F.col("id") * 10_000).alias("timestamp_ms"), none.alias("git_branch"), F.struct(F.col("id").alias("n")).alias("seq"))


def test_every_row_is_stored_once(spark, tmp_path, defaults):
    prompts(spark, 60_000).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    kept = Store(spark, str(tmp_path / "store"))
    assert kept.add_history(rows.where("seq.n % 3 > 0")) == 40_000
    assert logs.import_into(kept, rows.drop("seq", "git_branch")) == {"inserted": 20_000, "skipped": 40_000}
    assert kept.add_history(rows) == 0
    got = kept.history().agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("prompt")).first()
    assert tuple(got) == (60_000, 60_000, 1, 60_000, 60_000)
    first = kept.history().where("id <= 40000").select("id", F.substring_index(F.substring("prompt", 8, 9), " ", 1).cast("long").alias("n"))
    assert first.where("id <> n - floor(n / 3)").count() == 0  # in order of seq


def test_numbers_of_wide_rows_are_dense(spark, tmp_path, defaults):
    prompts(spark, 30_000, 20).write.parquet(str(tmp_path / "in"))
    out = store.numbered(spark.read.parquet(str(tmp_path / "in")), 100).select("id", "seq.n", "prompt")
    assert out.where("id <> n + 101").count() == 0 and out.count() == 30_000


def test_a_broken_run_leaves_no_id_twice(spark, tmp_path, monkeypatch):
    kept = Store(spark, str(tmp_path / "store"))
    assert kept.add_history(prompts(spark, 5, 1)) == 5
    monkeypatch.setattr(Store, "index", lambda self, *batches: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.add_history(prompts(spark, 8, 1))
    monkeypatch.undo()
    assert [r.prompt for r in kept.search(["prompt", "6"]).collect()] == ["prompt 6 abcd"]  # its files have no postings: they are read
    assert kept.add_history(prompts(spark, 10, 1)) == 2 and sorted(r.id for r in kept.history().collect()) == list(range(1, 11))
    kept.index()
    assert kept._batches() == (sorted(kept._batches()[0]), []) and [r.prompt for r in kept.search(["6"]).collect()] == ["prompt 6 abcd"]


def test_searches_read_the_files_that_may_match(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"))
    words = "alpha beta gamma delta épsilon zeta eta theta".split()
    for k in range(4):
        none = F.lit(None).cast("string")
        text = F.concat(F.lit(f"day{k} common "), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 8 + 1).cast("int")), F.lit(" of the end"))
        project = F.when(F.col("id") % 2 == 0, F.lit(f"/w/p{k}"))
        rows = spark.range(40).select(F.lit("codex").alias("source"), F.lit("s").alias("session_id"), project.alias("project"), text.alias("prompt"), none.alias("prompt_hash"), (F.col("id") + k * 86_400_000).alias("timestamp_ms"), none.alias("git_branch"), F.struct(F.col("id").alias("n")).alias("seq"))
        assert kept.add_history(rows) == 40
    whole = kept.history()
    queries = [
        ["day2"], ["common", "-day1"], ["-day1"], ["day3*"], ["da*", "epsilon"], ["nothere"], ["alpha", "day0"], "of the", ["the end"], ["p1"], [],
        lambda f: f.has("day1") | f.has("day2"), lambda f: ~f.has("day1"), lambda f: f.only("project").has("p3"), lambda f: f.but("project").has("p3"), lambda f: f.only("prompt").near(["day1", "end"], 5),
        lambda f: f.has("day0", first=True) & ~(f.has("alpha") | f.has("beta")), lambda f: f.has("--"), lambda f: f.has("day", prefix=True) & f.has("theta"),
    ]
    for q in queries:
        assert kept.search(q, 500).collect() == search.search(whole, q, 500).collect()
    files = len(whole.inputFiles())
    read = {name: len(kept.matching(q).inputFiles()) for name, q in (("one", ["day2"]), ("two", queries[11]), ("none", ["nothere"]), ("field", queries[13]), ("not", ["-day1"]))}
    assert 0 < read["one"] < read["two"] < files and read["none"] == 0 and 0 < read["field"] < files and read["not"] == files
    plan = kept.read("postings", "field string, token string, batch long, file string, rows long").where("token = 'day2'")._jdf.queryExecution().toString()
    assert "EqualTo(token,day2)" in plan
