import json
import random

from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators import learn
from annalist.sources import growing, logs


def texts(v, depth=0, out=None):
    out = [] if out is None else out
    if depth > 8 or len(out) > 200:
        return out
    if isinstance(v, str):
        if len(v.strip().encode()) > 2:
            out.append(v.strip()[:4000])
    elif isinstance(v, list):
        for x in v:
            texts(x, depth + 1, out)
    elif isinstance(v, dict):
        for k in learn.TEXT_KEYS:
            if k in v:
                texts(v[k], depth + 1, out)
    return out


def counts(v):
    if isinstance(v, str):
        lines = [x for x in v.split("\n") if not x.startswith(("+++", "---"))]
        return sum(x.startswith("+") for x in lines), sum(x.startswith("-") for x in lines)
    if isinstance(v, list):
        each = [counts(x) for x in v]
        return sum(a for a, _ in each), sum(b for _, b in each)
    if isinstance(v, dict):
        return next((c for k in logs.PATCH_KEYS if k in v and (c := counts(v[k])) != (0, 0)), (0, 0))
    return 0, 0


def anything(rng, depth, leaf, keys):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return leaf(rng)
    if kind < 0.6:
        return [anything(rng, depth - 1, leaf, keys) for _ in range(rng.randrange(1, 4))]
    return {rng.choice(keys): anything(rng, depth - 1, leaf, keys) for _ in range(rng.randrange(1, 4))}


def test_texts_and_patches_at_any_depth(spark):
    rng = random.Random(6)
    word = lambda r: r.choice(["hello there", " x ", "no", "", "é", 5, None, True, "w" * 5000, "  padded  "])
    patch = lambda r: r.choice(["+a\n-b\n+++ c\n+d", "--- a\n-b", "plain", "", 3, None, "+x"])
    rows = [anything(rng, 10, word, [*learn.TEXT_KEYS, "other"]) for _ in range(60)] + [["a b c"] * 300, [[["deep"] * 150, ["more"] * 100]]]
    for depth in range(7, 12):
        one = "bottom"
        for _ in range(depth):
            one = [one] if depth % 2 else {"content": one}
        rows.append(one)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "k int, value string").withColumn("v", F.parse_json("value"))
    got = {r.k: r.t for r in df.select("k", learn.text_fields(F.col("v")).alias("t")).collect()}
    assert got == {k: texts(v) for k, v in enumerate(rows)} and max(map(len, got.values())) == 201
    rows = [anything(rng, 10, patch, [*logs.PATCH_KEYS, "lines"]) for _ in range(60)]
    one = "+a\n-b"
    for k in range(12):
        one = [one] if k % 2 else {"diff": "none", "content": one}
    rows.append(one)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "k int, value string").withColumn("v", F.parse_json("value"))
    got = {r.k: tuple(r.c) for r in df.select("k", logs.lines_changed(F.col("v")).alias("c")).collect()}
    assert got == {k: counts(v) for k, v in enumerate(rows)} and got[60] == (1, 1)


def test_raw_transcripts_to_a_budget(spark):
    lines = [{"type": "user", "timestamp": "T1", "message": {"content": "see /home/ann/x"}}, {"role": "assistant", "timestamp": 1000, "content": [{"text": "abc"}, {"text": "def"}]}, {"type": 5, "role": "x", "text": "kept"}, {"type": "late", "text": "not reached"}]
    df = spark.createDataFrame([("f", k, json.dumps(v)) for k, v in enumerate(lines)] + [("f", 9, "bad"), ("g", 0, '{"text": "a"}')], "path string, line int, value string").withColumn("v", F.try_parse_json("value"))
    full = {r.path: r.transcript for r in learn.raw_transcripts(df).collect()}
    parts = ["### user T1\nsee /home/~/x", "### assistant 1970-01-01T00:00:01+00:00\nabc\ndef", "### event \nkept", "### late \nnot reached"]
    assert full == {"f": "\n\n".join(parts)}
    assert learn.raw_transcripts(df, len(parts[0]) + 1).first().transcript == "\n\n".join(parts[:2])


def test_first_lines_read_no_further(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\r\n" + b"x" * 100_000)
    (tmp_path / "b.jsonl").write_bytes("é no end".encode())
    (tmp_path / "c.jsonl").write_bytes(b"")
    (tmp_path / "d.jsonl").write_bytes(b"y" * 20_000 + b"\nz")
    got = {r.path.rsplit("/", 1)[1]: r.value for r in growing.first_lines(spark, str(tmp_path)).collect()}
    assert got == {"a.jsonl": "one", "b.jsonl": "é no end", "d.jsonl": "y" * 20_000}


def test_a_patch_is_computed_once_a_row(spark):
    """The counters name their patch once, however often they look at it."""
    patch = F.concat(F.lit("+++ b\n+a\n-b\n+c"), F.regexp_replace(F.col("id").cast("string"), "9", "\n-"))
    nested = F.parse_json(F.to_json(F.struct(F.array(patch).alias("content"))))
    for counts in (S.patch_counts(patch), logs.lines_changed(nested)):
        out = spark.range(10).select("id", counts.alias("c"))
        assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
        assert [tuple(r.c) for r in out.orderBy("id").collect()] == [(2, 1)] * 9 + [(2, 2)]
