import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from annalist.llm.substrings import LEAST, Words, deep_nodes, repeated_passages

BLANKS = "[\x20\x09-\x0d]+"


def plain(rows):
    """(doc_id, n_words, n_removed, kept) of each row, by a table of all passages."""
    texts = [[w for w in re.split(BLANKS, t or "") if w] for _, t in rows]
    first = {}
    for (i, _), words in zip(rows, texts, strict=True):
        for k in range(len(words) - LEAST + 1):
            p = tuple(words[k : k + LEAST])
            if i is not None:
                first[p] = min(i, first.get(p, i))
    out = []
    for (i, _), words in zip(rows, texts, strict=True):
        gone = {k + j for k in range(len(words) - LEAST + 1) if i is not None and first[tuple(words[k : k + LEAST])] < i for j in range(LEAST)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "a,b", "x" * 300]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(n) for n in (12, 13, 14, 30, 60)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (7, " ".join(passages[4]))]
    for i in range(10, 260):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice([fresh(rng.randrange(1, 30)), rng.choice(passages), passages[4][rng.randrange(20) : rng.randrange(30, 60)]])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    base = fresh(200)
    rows += [(300 + k, " ".join(base)) for k in range(40)] + [(350 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(60)]
    rows += [(420, " ".join(base[:50] * 8)), (421, " ".join(base[:50] * 3)), (300, " ".join(base)), (300, " ".join(fresh(50))), (None, " ".join(base)), (-4, " ".join(base[100:140])), (430, " ".join(fresh(60_000) + base))]
    rows += [(500 + k, " ".join(["same"] * (20 + k))) for k in range(5)]
    return rows


def test_equals_a_table_of_all_passages(spark):
    rows = corpus(random.Random(4))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, key int, digest string, n_words int").repartition(6)
    want = sorted(plain(rows), key=repr)
    for group in (1 << 19, 20):  # the second splits slots by all prefixes
        got = repeated_passages(df, group=group).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == want
        assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)
    assert sum(n for _, _, n, _ in want) > 10_000


def test_without_broadcast_of_few(spark, monkeypatch):
    rows = corpus(random.Random(5))
    monkeypatch.setattr("annalist.llm.substrings.FEW", 0)
    monkeypatch.setattr("annalist.llm.substrings.PART", 50)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(plain(rows), key=repr)


def test_words_of_several_texts():
    texts = ["a bb  a\n", "", "bb", "  ", "a a", "é\x0bbb"]
    data = [t.encode() for t in texts]
    h, text = Words()(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    names = [w for t in texts for w in re.split(BLANKS, t) if w]
    assert text.tolist() == [0, 0, 0, 2, 4, 4, 5, 5] and len(set(h.tolist())) == len(set(names))
    assert all((h[a] == h[b]) == (names[a] == names[b]) for a in range(len(h)) for b in range(len(h)))


def test_nodes_of_a_small_tree():
    marks = np.array([[1, 1, 1], [2, 1, 1], [1, 1, 3], [1, 1, 1], [1, 1, 1]], np.uint32)
    order, starts = deep_nodes(marks, np.array([5, 6, 7, 5, 9], np.uint64))
    assert sorted(order[:2].tolist()) == [0, 3] and order[2:].tolist() == [4, 2, 1] and starts.tolist() == [0, 2, 3, 4]
    assert deep_nodes(marks[:1], np.array([5], np.uint64))[1].tolist() == [0] and LEAST == 13


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_passages(df).collect() == [] and repeated_passages(df.union(spark.range(1).select(F.lit(None).cast("long"), F.lit("x")))).count() == 1
