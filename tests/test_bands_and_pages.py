import json
import random

from pyspark.sql import functions as F

from annalist.operators import search
from annalist.sources import logs, paged


def pairs(rows, span):
    return sorted((a[0], b[0], b[2] - a[2]) for a in rows for b in rows if a[0] != b[0] and abs(a[2] - b[2]) <= span and (a[1] is None or b[1] is None or a[1] != b[1]))


def test_context_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(3_000_000), 1_000_000 + rng.randrange(20_000), 5])) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, session_id string, timestamp_ms long")
    for minutes, most in ((1, 1 << 20), (5, 500), (0, 100)):
        assert sorted(map(tuple, search.context_pairs(df, minutes, most).collect())) == pairs(rows, minutes * 60_000)
    assert search.context_pairs(df.limit(0)).count() == 0


def test_a_busy_hour_is_dealt_out(spark):
    """Nine tenths of the rows lie in one minute: the pieces of their ranges share the candidate pairs evenly."""
    busy = spark.range(3_000).select("id", F.col("id").cast("string").alias("session_id"), (F.col("id") * 20).alias("timestamp_ms"))
    rest = spark.range(3_000, 3_300).select("id", F.col("id").cast("string").alias("session_id"), (F.col("id") * 60_000).alias("timestamp_ms"))
    out = search.context_pairs(busy.union(rest), 1, 100_000)
    join = out._jdf.queryExecution().analyzed().toString()
    assert "piece" in join and out.count() == 3_000 * 2_999 + 2 * 300 - 2
    sizes = sorted(r["count"] for r in out.groupBy(F.pmod(F.xxhash64("a"), F.lit(16))).count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_pages_go_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "pages"

    def put(channel, first, last):
        (folder / channel).mkdir(parents=True, exist_ok=True)
        for n in range(first, last):
            (folder / channel / f"{n:06}").write_text(json.dumps({"id": f"{n:06}", "from_name": "bo", "text": f"{channel} {n} é", "created_at": "2024-01-01T00:00:00Z"}))

    def newest(channel):
        return max((p.name for p in (folder / channel).iterdir()), default=None) if (folder / channel).exists() else None

    def page(channel, after):
        return [json.loads(p.read_text()) for p in sorted((folder / channel).iterdir()) if after is None or p.name > after][:10]

    def run():
        stream = paged.stream_pages(spark, ["a", "b", "none"], newest, page)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        query.awaitTermination()
        return sorted(r.prompt for r in logs.relay_messages(spark.read.schema(paged.SCHEMA).parquet(str(tmp_path / "out"))).collect())

    put("a", 0, 25)
    put("b", 0, 3)
    want = [f"[bo] a {n} é" for n in range(25)] + [f"[bo] b {n} é" for n in range(3)]
    assert run() == sorted(want)
    put("a", 25, 40)
    want += [f"[bo] a {n} é" for n in range(25, 40)]
    assert run() == sorted(want) == run()
    reader = paged.PageReader(["a"], newest, page)
    got = list(reader.read(reader.partitions({"a": "000030"}, {"a": "000035"})[0]))
    assert [m["id"] for _, v in got for m in json.loads(v)["data"]] == [f"{n:06}" for n in range(31, 36)] and reader.partitions({"a": "5"}, {"a": "5"}) == []


def test_pairs_over_a_long_time_look_at_few_candidates(spark):
    """Prompts a minute apart over years, in one small table: the join's rows grow with the prompts, whatever ranges would be cut."""
    rows = spark.range(40_000).select("id", F.col("id").cast("string").alias("session_id"), (F.col("id") * 60_000).alias("timestamp_ms"))
    out = search.context_pairs(rows, 5)
    join = out._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in join and out.count() == 40_000 * 10 - 30
    early = [(k, "ab"[k % 2], t) for k, t in enumerate([-600_001, -300_001, -300_000, -1, 0, 1, 299_999, 300_000, 300_001, None])]
    df = spark.createDataFrame(early, "id long, session_id string, timestamp_ms long")
    assert sorted(map(tuple, search.context_pairs(df, 5).collect())) == pairs([r for r in early if r[2] is not None], 300_000)
