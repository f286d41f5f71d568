import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from annalist.llm.bpe import encode_and_decode, encode_words, rank_literal, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "a", " a  b \n c\n\nd ", "The cat's  hat.\nNext line\twith tab", "  lead", "trail  ", "日本語テスト é ñ çé", "x" * 3000, "ab" * 300 + "c", "###$$$ %%%&&& 123 45678901234567890", "same text", "same text", "réeux achlichber bomenteco", "🙂🙂 zero​width", "nb sp  wide", "Ab" * 40 + "aaaaab" * 30]


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_fold_equals_the_library(spark):
    e, ranks = encoding(), rank_literal(read_ranks(PATH))
    words = [" unbelievable", "abcabcabc", "aaaaaaaa", "日本語テスト", "ñandú", "qzxj" * 50, "aa" * 100, " the", "x", "Donaudampfschifffahrt" * 5]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", encode_words(F.col("w"), ranks).alias("ids")).collect()
    for r in rows:
        assert e._encode_single_piece(r.w) == list(r.ids), r.w


def test_documents_equal_the_library(spark):
    e = encoding()
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, word int").repartition(3)
    for parts in (1, 3):
        rows = encode_and_decode(docs.coalesce(parts), PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            text = TEXTS[r.doc_id] or ""
            ids = e.encode_ordinary(text)
            assert list(r.ids) == ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_and_decode(docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_words_of_another_partition_are_found(spark, monkeypatch):
    from annalist.llm import bpe

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    path = bpe.write_words(docs, public_tokenizers.PATTERN, read_ranks(PATH))
    empty, own = bpe.BlockWords(path, 77), bpe.BlockWords(path, 0)
    assert not empty.ids and own.ids["The"] and not own.bytes and all(own.decoded(w) == w.encode() for w in own.ids)
    empty.lack(["The", " cat"])
    assert empty.ids == {w: own.ids[w] for w in ("The", " cat")}


def plain_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    p = [word[i : i + 1] for i in range(len(word))]
    while len(p) > 1 and (least := min(ranks.get(a + b, 2**31) for a, b in zip(p, p[1:], strict=False))) < 2**31:
        i = next(i for i in range(len(p) - 1) if ranks.get(p[i] + p[i + 1]) == least)
        p[i : i + 2] = [p[i] + p[i + 1]]
    return [ranks[x] for x in p]


def test_fold_and_decoding_with_any_ranks(spark, monkeypatch):
    """Ranks in no order of learning, so that a part may rank above the whole; short and long words follow one rule."""
    import random

    from annalist.llm import bpe

    r = random.Random(6)
    for short in (bpe.SHORT, 2):
        monkeypatch.setattr(bpe, "SHORT", short)
        tokens = [b"a", b"b", b"c"] + list({bytes(r.choices(b"abc", k=r.randint(2, 5))) for _ in range(40)})
        numbers = list(range(len(tokens)))
        r.shuffle(numbers)
        ranks = dict(zip(tokens, numbers, strict=True))
        words = ["".join(r.choices("abc", k=r.randint(1, 90))) for _ in range(120)] + ["ab" * 70, "a" * 150, "abc" * 40]
        rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", encode_words(F.col("w"), rank_literal(ranks)).alias("ids"))
        for x in rows.select("w", "ids", bpe.decode_words(F.col("ids"), ranks).alias("d")).collect():
            assert list(x.ids) == plain_merges(x.w.encode(), ranks), x.w
            assert bytes(x.d) == x.w.encode()


def test_vocabulary_is_neither_in_the_plan_nor_in_its_rows(spark, monkeypatch):
    """With the vocabulary as literals the texts of the plan took megabytes of the driver, again with each change of the plan."""
    from annalist.llm import bpe

    plans, outputs, kind = [], [], type(spark.range(0))

    def walk(node):
        outputs.append([node.output().apply(i).name() for i in range(node.output().size())])
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    def seen(frame, *args, of=kind.repartition):
        plans.append(of(frame, *args))
        return plans[-1]

    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    monkeypatch.setattr(kind, "repartition", seen)
    bpe.write_words(docs, public_tokenizers.PATTERN, read_ranks(PATH))
    words = plans[-1]._jdf.queryExecution()
    assert len(words.toString()) < 200_000
    walk(words.optimizedPlan())
    walk(words.executedPlan().inputPlan())
    assert outputs and not any(x in ("ranks", "pieces") for names in outputs for x in names)


def test_odd_rows_equal_the_library(spark):
    e = encoding()
    long = "word " * 300_000 + "é" * 200
    rows = [(None, "no id"), (None, None), (3, "twice"), (3, "twice"), (3, "other"), (4, long), (5, "")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, block int").repartition(2)
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in encode_and_decode(docs, PATH, public_tokenizers.PATTERN).collect())
    assert got == sorted((i or 0, len(e.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_pieces_are_cut_as_by_the_pattern_and_kept_within_bounds():
    import regex

    from annalist.llm.pieces import MARKS, Kept, matcher

    own, find = matcher(), regex.compile(public_tokenizers.PATTERN).findall
    for m in [*MARKS, "***", "'s", ".'", "'re", "$%&", "’", "_\nthe'll", "'\nx_"]:
        for piece in ("word" + m, " ñandú" + m, " " + m, m + "x", "it" + m + m):
            assert own(piece) == find(piece), piece
    asked = []
    kept = Kept(4, lambda x: asked.append(x) or x * 2)
    for x in ("a", "b", "c", "a", "d"):
        kept.trim()
        assert kept[x] == x * 2
    assert asked == ["a", "b", "c", "d"] and len(kept) + len(kept.old) <= 6
