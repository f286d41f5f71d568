import zlib
from array import array

import public_tokenizers
import pytest

from annalist.llm.pieces import cut
from annalist.llm.sharding import shard_by_bytes
from annalist.llm.token_files import read_token_files, token_digests, tokenise_to_orc, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", " a  b \n c\n\nd ", "The cat's  hat.\nNext line\twith tab", "  lead", "trail  ", "日本語 テスト é ñ", "x" * 3000, "a b " * 900, "same text", "same text", "\x1c odd \x1f space", "nb sp  wide", "<|endoftext|> here"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, start long").repartition(3)


def test_cut_is_lossless():
    for t in TEXTS:
        assert " ".join(cut(t or "")) == (t or "")


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want, start = {}, 0
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenise_to_orc(docs, PATH).collect()}
    assert got == want


def test_starts_point_into_the_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "two two"), (3, None), (3, "three three three"), (None, "no id"), (None, "none"), (9, TEXTS[9]), (9, TEXTS[9])] + [(7, f"hot {i} " * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    write_token_files(docs, str(tmp_path / "t"), PATH)
    stream = [r for r in read_token_files(spark, str(tmp_path / "t")).orderBy("row").collect()]
    assert [r.doc_id for r in stream] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    told = token_digests(spark, str(tmp_path / "t")).orderBy("row").collect()
    start = 0
    for r, x in zip(told, stream, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (x.doc_id, start, len(x.ids), zlib.crc32(array("I", x.ids).tobytes()))
        start += len(x.ids)
    encoded = sorted((x or 0, t or "") for x, t in rows)
    assert len(stream) == len(encoded)


def test_another_kind_of_file_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    from annalist.llm.token_files import PieceEncoder

    assert PieceEncoder(PATH).plain
    file = json.loads(open(PATH).read())
    file["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(file))
    other, t = PieceEncoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not other.plain
    texts = [x or "" for x in TEXTS]
    assert other.encode(texts) == [array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]


def test_token_files_prune_by_id(spark, docs, tmp_path):
    write_token_files(docs, str(tmp_path / "t"), PATH)
    df = read_token_files(spark, str(tmp_path / "t")).where("doc_id = 2")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,2)]" in df._jdf.queryExecution().toString()
    assert [r.ids[-1] for r in df.collect()] == [0]


def test_shards(spark, docs):
    rows = sorted(shard_by_bytes(docs, 4).collect(), key=lambda r: r.doc_id)
    assert [r.size for r in rows] == [len((t or "").encode()) + 1 for t in TEXTS]
    assert [r.text_crc32 for r in rows] == [zlib.crc32((t or "").encode()) for t in TEXTS]
    total, before, slots = sum(r.size for r in rows), 0, {}
    for r in rows:
        assert r.shard == before * 4 // total
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        before += r.size


def test_empty_and_repeated(spark, docs):
    assert shard_by_bytes(docs.limit(0)).count() == 0
    assert tokenise_to_orc(docs.limit(0), PATH).count() == 0
    twice = docs.union(docs)
    assert shard_by_bytes(twice).count() == 2 * len(TEXTS)
    assert tokenise_to_orc(twice, PATH).count() == 2 * len(TEXTS)


def test_shards_of_null_and_tied_ids(spark):
    rows = [(None, "a"), (None, "bb"), (1, "x"), (1, "x"), (1, None), (2, "y" * 5000), (3, "")]
    docs = spark.createDataFrame([(*r, "t", 5) for r in rows], "doc_id long, text string, law string, size int").repartition(3)
    got = shard_by_bytes(docs, 3).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(t or "") + 1) for i, t in rows)
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r.shard for r in got if r.doc_id is None} == {0} and all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_matches_equal_the_pattern():
    import regex

    from annalist.llm.pieces import BYTE_LEVEL, matcher

    assert BYTE_LEVEL == public_tokenizers.PATTERN
    find = regex.compile(BYTE_LEVEL).findall
    for t in [*TEXTS, "don't stop, we'll!! go... ok?", "a1 b2, c3.", "x's y've", "ǅ ª º ⅷ ²", " 'tis", "é, ñ."]:
        first, *rest = cut(t or "")
        assert [m for x in [first, *(" " + y for y in rest)] for m in matcher()(x)] == find(t or "")


def test_added_tokens_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from annalist.llm.queries import QUERIES

    texts = ["hello <|endoftext|> world", "<|endoftext|>", "plain text", None, "a<|endoftext|><|endoftext|> b ", "<|endoftext", "last one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t, want, start = Tokenizer.from_file(PATH), {}, 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    assert t.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, str(tmp_path)).collect()}
    assert got == want


def test_shards_of_one_id_in_most_rows(spark):
    """Rows of one id are cut by the other numbers of the order, and land in several range partitions."""
    rows = [(7, f"text {k} " + "x" * (k % 50)) for k in range(4000)] + [(k, "y" * 40) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shard_by_bytes(docs, 8).collect()
    size = {s: sum(r.size for r in got if r.shard == s) for s in range(8)}
    assert len(got) == 4500 and max(size.values()) - min(size.values()) < 200 and len({r.shard for r in got if r.doc_id == 7}) > 5
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
