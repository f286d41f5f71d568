import hashlib
import random
import re

import pytest

from annalist.llm.decontaminate import Pattern, contaminated, plain, without_leaks
from annalist.llm.licenses import PHRASES, scan_licenses
from annalist.llm.warc import Reader, read_archives, record, write_archives

ITEM = "What is the capital of the province where the oldest railway bridge of the northern coast was built in 1872?"
OTHER = "A train leaves the station at nine and travels for three hours at sixty miles an hour before it stops."


def distance(item, text):
    """Fewest edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[:], i
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def edited(text, n, seed):
    r = random.Random(seed)
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        how = r.randrange(3)
        if how == 0:
            out[i] = r.choice("abcdefgh")
        elif how == 1:
            del out[i]
        else:
            out.insert(i, r.choice("abcdefgh"))
    return "".join(out)


def test_search_equals_brute_force():
    p = Pattern(plain(ITEM), 10)
    for n in range(0, 16):
        text = plain("noise before it " + edited(ITEM, n, n) + " and noise after")
        assert p.search(text)[0] == distance(p.text, text)
    assert "".join(x for _, x in p.pieces()) == p.text and len(p.pieces()) == p.k + 1


def test_contaminated_equals_brute_force(spark):
    texts = [None, "", "...", ITEM, "x " * 500 + ITEM.upper() + " y", OTHER[:50], "a clean text of its own", "short one", "shorts one"]
    texts += ["lead " * 20 + edited(ITEM, n, n + 50) + " tail" * 20 for n in range(1, 16)] + [ITEM + " " + OTHER]
    texts += ["lead in which citi is the capital of it here", "of cheese and vine we ate", "tiny rat", None, ITEM]
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, item_id int")
    items = {1: ITEM, 2: OTHER, 3: "short one", 4: "", 5: None, 6: ITEM, 7: "which city is the capital of it", 8: "cheese and wine", 9: "a rat"}
    bench = spark.createDataFrame([(i, t) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in contaminated(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in items.items():
            p = Pattern(plain(item), 10)
            if not p.m:
                continue
            d = distance(p.text, plain(t))
            if d <= p.k and (p.k or f" {p.text} " in f" {plain(t)} "):
                want[i, k] = d
    assert got == want and len(want) > 15 and {7, 8} <= {k for _, k in want}
    nameless = spark.createDataFrame([(None, ITEM), (None, "clean"), (2, ITEM), (2, ITEM)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(nameless, bench.where("item_id = 1")).collect()) == [(0, 1), (2, 1), (2, 1)]
    assert [r.doc_id for r in without_leaks(nameless, bench).collect()] == [None, None]
    left = {r.doc_id for r in without_leaks(docs, bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ü" * 400 + "</p>"
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", "tiny"), (4, "http://d", "tiny"), (5, "http://e", None), (6, "http://f", big), (7, "http://g", "\r\n\r\nWARC/1.1" * 20), (8, "http://h", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in read_archives(archives).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i in (2, 6) else ("response", None))
        assert got[i].payload == (None if i in (2, 6) else (html or ""))
    assert got[1].url == "http://a/%20b%0A"
    assert read_archives(write_archives(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_archives_are_read_in_parallel(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, "u", f"{i} " * 200) for i in range(60)], "page_id long, url string, html string").repartition(3)
    tasks = {}
    for size in (1, 10_000):
        archives = write_archives(pages, str(tmp_path / f"w{size}"), archive_bytes=size).cache()
        read = read_archives(archives).withColumn("task", F.spark_partition_id())
        tasks[size] = (archives.count(), read.select("task").distinct().count(), read.select("page_id").distinct().count())
    assert tasks[1][0] == 60 and tasks[1][1] > 40 and tasks[1][2] == tasks[10_000][2] == 60 and tasks[10_000][1] == tasks[10_000][0] < 10


def test_warc_odd_pages(spark, tmp_path):
    long, other = "a" * 150, "b" * 99
    rows = [(None, "u", long), (None, None, None), (4, "u", long), (4, "u", long), (9, "v", long), (9, "v", other), (11, "w", other), (12, "", "c" * 100), (13, "", "c" * 100), (13, "", "c" * 100)]
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, refers_to int")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in read_archives(write_archives(pages, str(tmp_path / "w"))).collect()))
    assert got == sorted([(0, 150, "response", 0), (0, 0, "response", 0), (4, 150, "response", 0), (4, 150, "response", 0), (9, 150, "revisit", 4), (9, 99, "response", 0), (11, 99, "response", 0), (12, 100, "response", 0), (13, 100, "revisit", 12), (13, 100, "revisit", 12)])


def test_reader_rejects_damage():
    import io

    digest = hashlib.sha256(b"hello").hexdigest()
    good = record(1, "u", b"hello", digest, None, "2024-01-01T00:00:00Z")
    assert [h["x-page-id"] for h, _ in Reader(io.BytesIO(good + good))] == ["1", "1"]
    with pytest.raises((ValueError, Exception)):
        list(Reader(io.BytesIO(good[:-9])))


def test_licenses(spark):
    texts = [
        None,
        "",
        "Released under the MIT License. under the mit license",
        "Licensed under the Apache License, Version 2.0. CC-BY-NC",
        "Licenced undr the GNU Generl Public License, version 3.",
        "plain text of nobody",
        "Permission is hereby granted, free of charge, to any persons obtaining a copy",
        "é under the MIT é license",
        "cc by nc cc by nc by nc",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = sorted((k, lab) for p, lab in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1
    assert rows[4].labels == "gpl-3" and rows[4].base_labels == "" and 0.8 < rows[4].score < 1 and rows[4].spans[0].edits >= 3
    assert rows[6].labels == "mit" and rows[5].labels == "" and rows[5].score == 0
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices_equal_plain_distances(spark):
    """A notice with edits among other words: the label and the edits of the notice that is nearest, by a plain edit distance."""
    from annalist.llm.licenses import NOTICES, PERCENT

    r = random.Random(11)
    other = "river stone thing above cloud winter paper silver under many".split()
    texts, want = [], []
    for i in range(48):
        notice = NOTICES[i % len(NOTICES)][0]
        edits = r.randint(0, len(notice) * PERCENT // 100 + 4)
        inside = edited(notice, edits, 100 + i)
        text = " ".join(re.findall("[a-z0-9]+", " ".join([*r.choices(other, k=4), inside, *r.choices(other, k=4)])))
        words, best = text.split(), {}
        starts = [len(" ".join(words[:k])) + (k > 0) for k in range(len(words))]
        ends = [s + len(w) for s, w in zip(starts, words, strict=True)]
        for n, (body, label) in enumerate(NOTICES):
            k = len(body) * PERCENT // 100
            if distance(body, text) > k:
                continue
            bounds = {*starts, *ends}
            for a in bounds:  # from one side of a word to another: a row of distances from each
                row = list(range(len(body) + 1))
                for b in range(a, min(len(text), a + len(body) + k + 1)):
                    last, row = row, [b - a + 1]
                    for j, c in enumerate(body, 1):
                        row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != text[b])))
                    if b + 1 in bounds and row[-1] <= k:
                        best[n] = min(best.get(n, 99), row[-1])
        texts.append(text)
        want.append(min(((d / len(NOTICES[n][0]), -len(NOTICES[n][0]), NOTICES[n][1], d) for n, d in best.items()), default=None))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {x.doc_id: x for x in scan_licenses(docs).collect()}
    assert sum(x is not None for x in want) > 25 and sum(x is None for x in want) > 2
    for i, x in enumerate(want):
        spans = rows[i].spans
        assert bool(spans) == (x is not None), texts[i]
        if x:
            least = min(spans, key=lambda s: s.edits)
            assert least.edits == x[3] and x[2] in rows[i].labels.split(","), (texts[i], x)


def test_licenses_of_odd_rows(spark):
    long = "filler words " * 100_000 + "Released under the MIT License"
    docs = spark.createDataFrame([(None, "under the mit license"), (1, long), (2, "cc by nc"), (2, "cc by nc"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in scan_licenses(docs).collect())
    assert got == [(0, 0, 0, ""), (0, 4, 1, "mit"), (1, 200_005, 1, "mit"), (2, 3, 1, "cc-by-nc"), (2, 3, 1, "cc-by-nc")]


def test_filters_lose_no_match():
    import ahocorasick

    from annalist.llm.decontaminate import found_in

    r = random.Random(9)
    words = ["the", "of", "and", "then", "thing", "river", "stone", "at", "in", "other", "another"]
    for seed in range(300):
        item = plain(" ".join(r.choices(words, k=r.randint(2, 40))))
        p = Pattern(item, 10)
        automaton = ahocorasick.Automaton()
        owners: dict = {}
        for i, (offset, piece) in enumerate(p.pieces()):
            owners.setdefault(piece, []).append((0, i, offset, len(piece), *p.beside(i)))
        for piece, o in owners.items():
            automaton.add_word(piece, o)
        automaton.make_automaton()
        text = plain(" ".join(r.choices(words, k=30)) + " " + edited(item, r.randint(0, p.k + 3), seed) + " " + " ".join(r.choices(words, k=30)))
        best = p.search(text)[0]
        if not p.k:
            best = 0 if f" {item} " in f" {text} " else 1
        got = found_in(text, automaton, {0: p})
        assert (best <= p.k) == bool(got), (seed, best, p.k)
        if got:
            assert got[0][0] == best


def test_many_places_take_linear_time():
    """40 times the places take no more than some 40 times as long: word numbers run along, spans look at their neighbours."""
    import time

    from annalist.llm.licenses import NOTICES, Notices, base_places, in_words

    notices = Notices()

    def took(n):
        text = " ".join(["x under the mit license y"] * n)
        began = time.perf_counter()
        places, spans = base_places(text), notices.spans(" ".join([f"q {NOTICES[1][0]} r"] * (n // 10)))
        told = in_words(" ".join([f"q {NOTICES[1][0]} r"] * (n // 10)), spans)
        assert [p for p, _ in places] == [6 * k + 1 for k in range(n)] and [t["first_word"] for t in told] == [7 * k + 1 for k in range(n // 10)] and told[-1]["last_word"] == 7 * (n // 10) - 2
        return time.perf_counter() - began

    took(100)
    few, many = took(2_500), took(100_000)
    assert many < 160 * few + 1
