import random
import re
from collections import Counter, defaultdict

import numpy as np

from annalist.llm.components import connected
from annalist.llm.minhash import BANDS, ROWS, Shingles, band_keys, minima, near_duplicates, packed
from annalist.llm.templates import dropped_lines, without_recurring_lines


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute_components(texts, n, percent=80):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sets, [find(i) for i in range(len(texts))]


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(20, 120))) for _ in range(12)]
    texts = ["", None, " \n", "one", "ONE", "One two", "one  two", "É a", "é a"]
    for b in base:
        texts.append(b)
        w = b.split()
        for _ in range(9):  # a chain of small changes, and changes of the first
            v = w[:] if r.random() < 0.5 else texts[-1].split()
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = r.choice(words)
            texts.append(" ".join(v))
    hub = " ".join(r.choices(words, k=60)).split()
    for i in range(120):  # a large group whose members differ more from each other than from the first
        v = hub[:]
        for k in range(i % 4):
            v[(i * 7 + k * 13) % 60] = f"x{i}{k}"
        texts.append(" ".join(v))
    return texts + texts[:40]


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], "doc_id long, text string, class_id string, kept string").repartition(4)
    for n in (2, 5):
        sets, want = brute_components(texts, n)
        rows = {r.doc_id: r for r in near_duplicates(docs, words=n).collect()}
        assert len(rows) == len(texts)
        for i in range(len(texts)):
            assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(sets[i]), want[i], want[i] == i), (n, i)
        assert max(Counter(want).values()) > 50


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h i"), (None, None), (5, "a b c")], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 1, -1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (5, 1, 1)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_estimate_and_recall():
    s = Shingles(1)
    r = random.Random(1)
    errors, met = [], 0
    for _ in range(150):
        a = [f"t{r.random()}" for _ in range(200)]
        b = a[:178] + [f"u{r.random()}" for _ in range(22)]  # similarity 0.80
        x, y = s(" ".join(a)), s(" ".join(b))
        mx, my = minima(x), minima(y)
        met += bool(set(band_keys(mx)) & set(band_keys(my)))
        p, q = packed(mx), packed(my)
        n = len(p) // 2
        differ = sum(int(v).bit_count() for v in ((p[:n] ^ q[:n]) | (p[n:] ^ q[n:])).astype(np.uint64))
        errors.append((1 - differ / (BANDS * ROWS) - 0.25) / 0.75 - 178 / 222)
    assert met == 150 and abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.12


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1050)] + [(3, 3), (9, 8)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(1000, 1050)]} | {8: 8, 9: 8}
    assert got == want
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_templates(texts, min_docs=3):
    """({doc: dropped line numbers}, {doc: cut sentences}) by plain loops."""
    units = []
    for d, t in enumerate(texts):
        for at, line in enumerate((t or "").split("\n")):
            own = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
            told = [(-1, own)] if len(own) >= 4 else []
            if len(own) > 50:
                for k, s in enumerate(re.findall(r"(?s).*?[.!?][\x20\x09-\x0D]+|.+", line)):
                    words = [x for x in re.split(r"[\x20\x09-\x0D]+", s) if x]
                    told += [(k, words)] * (len(words) >= 8)
            for part, words in told:
                few = 2 * sum(bool(re.search("[0-9@]", x)) for x in words) <= len(words)
                units.append((d, at, part, tuple("<*>" if few and re.search("[0-9@]", x) else x for x in words)))
    docs_of, born = defaultdict(set), {}
    for d, at, part, tok in units:
        docs_of[tok].add(d)
        born[tok] = min(born.get(tok, (d, at, part)), (d, at, part))
    rank = {t: (len(docs_of[t]), *(-x for x in born[t])) for t in docs_of}
    keys, own_keys = defaultdict(set), {}
    for t in docs_of:
        if len(t) >= 6:
            n = len(t)
            parts = n * 30 // 100 + 1
            own_keys[t] = [(n, t[:3], i, t[3 + i * (n - 3) // parts : 3 + (i + 1) * (n - 3) // parts]) for i in range(parts)]
            for k in own_keys[t]:
                keys[k].add(t)
    tops = {k: max(v, key=rank.get) for k, v in keys.items()}
    better = {t: {tops[k] for k in ks if tops[k] != t and 100 * sum(a == b for a, b in zip(tops[k], t, strict=True)) >= 70 * len(t)} for t, ks in own_keys.items()}
    member = {t: max(roots, key=rank.get) for t, c in better.items() if (roots := [x for x in c if not better[x]])}
    found = defaultdict(set)
    for d, _, _, tok in units:
        found[member.get(tok, tok)].add(d)
    gone = {(d, at, part) for d, at, part, tok in units if len(found[member.get(tok, tok)]) >= min_docs and d > min(found[member.get(tok, tok)])}
    lines, cuts = defaultdict(list), defaultdict(list)
    for d, at, part in sorted(gone):
        if part < 0:
            lines[d].append(at)
        elif (d, at, -1) not in gone:
            cuts[d].append(f"{at}:{part}")
    return dict(lines), {d: sorted(x) for d, x in cuts.items()}


PASSAGE = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def varied_corpus():
    r = random.Random(5)
    texts = [None, "", "\n \n"]
    words = PASSAGE.split()
    for i in range(40):
        own = [" ".join(f"u{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('abcdefgh')}" for _ in range(r.randint(4, 14))) for _ in range(4)]
        own.append(f"Posted by user{i} on day {i} of the month at noon")
        own.append(f"The server host {r.choice(['alpha', 'beta', 'gamma'])} has answered with code {i}")
        own.append(f"The server host is down for {r.choice(['good', 'now', 'ever'])} and ever again today")
        own.append(" ".join(["We", "all", "think", *r.choices(["ab", "cd", "ef"], k=r.choice([3, 4, 7]))]))
        own.append(" ".join(["at", "the", "end", *(w if r.random() < 0.85 else r.choice("xyz") for w in "of this day we went down to the old sea side".split())]))
        if i % 3 == 0:
            own.append(PASSAGE)
        if i % 4 == 1:
            own.append(" ".join(f"v{i}k{k}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for k in range(25)) + ". " + " ".join([*words[:20], "name" + "abcdefg"[i % 7], *words[21:40]]) + "! " + " ".join(words[40:]) + ".")
        if i % 2:
            own += ["short one here", "exactly four words here"]
        texts.append("\n".join(own))
    return texts + [texts[5], texts[5]]


def test_templates_equal_plain_loops(spark):
    texts = varied_corpus()
    docs = spark.createDataFrame([(i, t, 1, "x", "y", i) for i, t in enumerate(texts)], "doc_id long, text string, at int, lines string, row string, n_chars long").repartition(3)
    lines, cuts = plain_templates(texts)
    rows = {x.doc_id: x for x in dropped_lines(docs).collect()}
    assert {d: list(x.dropped) for d, x in rows.items() if x.n_dropped} == lines
    assert {d: list(x.cut) for d, x in rows.items() if x.n_cut} == cuts
    assert sum(map(len, lines.values())) > 60 and sum(map(len, cuts.values())) > 8 and len(rows) == len(texts)
    kept = {x.doc_id: x for x in without_recurring_lines(docs).collect()}
    for d, text in enumerate(texts):
        if d not in lines and d not in cuts:
            assert kept[d].text == text and kept[d].n_chars == d
            continue
        out = []
        for at, line in enumerate(text.split("\n")):
            if at in lines.get(d, ()):
                continue
            parts = re.findall(r"(?s).*?[.!?][\x20\x09-\x0D]+|.+", line)
            left = "".join(x for k, x in enumerate(parts) if f"{at}:{k}" not in cuts.get(d, ()))
            out += [left] if left or not parts else []
        want = "\n".join(out)
        assert (d in kept) == bool(want.split()), d
        if d in kept:
            assert kept[d].text == want and kept[d].n_chars == len(want) and kept[d].lines == "x"
    assert sum(PASSAGE in (x.text or "") for x in kept.values()) == 1
    assert dropped_lines(docs.limit(0)).count() == 0


def test_templates_equal_their_sql(spark, tmp_path):
    import duckdb

    from annalist.llm.templates import ORACLE

    texts = varied_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted((r[0], r[2], r[3], r[5]) for r in db.execute(ORACLE).fetchall())
    assert sorted((r.doc_id, r.n_dropped, list(r.dropped), list(r.cut)) for r in dropped_lines(docs).collect()) == want


def test_long_lines_that_differ_in_a_word_recur(spark):
    own = "A line of its own in document number"
    words = PASSAGE.split()
    texts = [f"{own} x{'abcdefg'[i] * 3}y\n" + " ".join([*words[:30], "name" + "abcdefg"[i], *words[31:]]) for i in range(7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {x.doc_id: x.text for x in without_recurring_lines(docs).collect()}
    assert [i for i in kept if words[0] in kept[i]] == [0]


def test_all_templates_of_a_leaf(spark):
    """A leaf of many templates, some of whose variable words give each document its own form; none is left out."""
    names = "abcdefg"
    kinds = ["We all think apples are red {}", "We all think the sky was {}", "We all think {} must go home", "We all think that {} is gone", "We all think of {} every day"]
    texts = ["\n".join(k.format("name" + x) for k in kinds) for x in names]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string").repartition(3)
    rows = {x.doc_id: list(x.dropped) for x in dropped_lines(docs).collect()}
    assert rows == {0: [], None: []} | {i: [0, 1, 2, 3, 4] for i in range(1, 7)}


def test_units_of_odd_texts():
    from annalist.llm.templates import line_units

    text = "a1 b c d\x0be\n\n1 2 3 d\nx\x1cy z w\nshort @ one here now é\n" + "Seven words of a sentence end here. " * 8
    units = [(at, part, n, head.decode(), form.decode()) for at, part, n, head, form in line_units(text.encode())]
    assert units[0] == (0, -1, 5, "5 <*> b c", "<*> b c d e") and units[1] == (2, -1, 4, "4 1 2 3", "1 2 3 d")
    assert units[2] == (4, -1, 6, "6 short <*> one", "short <*> one here now é") and units[3][:3] == (5, -1, 56) and len(units) == 4
    long = " ".join(["w"] * 43) + ". " + "An eighth word makes it a unit 7.\t" + "This ends it"
    assert [(at, part, n) for at, part, n, _, _ in line_units(long.encode())] == [(0, -1, 54), (0, 0, 43), (0, 1, 8)]
