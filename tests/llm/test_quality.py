import re
from collections import Counter

from annalist.llm.quality import BOILERPLATE, quality, quality_digest



class Clean:
    def __mod__(self, i):
        return " ".join(f"{w}{i}" for w in "the quick brown fox jumps over a lazy dog".split()) + "."


CLEAN = Clean()
TEXTS = [
    None,
    "",
    " \n\t\r\n ",
    "one",
    "\n".join(CLEAN % i for i in range(8)),
    "\n".join(["Same line of text here again."] * 30),
    " | ".join(f"item{i}" for i in range(80)),
    "\n".join([CLEAN % i for i in range(8)] + ["Home | News | About | Contact"]),
    "\n".join([CLEAN % i for i in range(8)] + ["Please read our Cookie Policy and Terms of Use."]),
    " ".join(f"word{i}%%%" for i in range(90)),
    " ".join(f"WORD{i}!!" for i in range(90)),
    "a b c a b c " + " ".join(f"w{i}" for i in range(100)),
    "x\x0by\x0cz\tq " * 30,
    "é ñ ü 日本 " + " ".join(f"ü{i}" for i in range(60)),
    "\n".join(CLEAN % i for i in range(8)),
    "long " + " ".join(f"t{i}" for i in range(30000)),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept int, source string")
    rows = {r.doc_id: r for r in quality_digest(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), i


def test_verdicts_and_clean_text(spark):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept int, source string")
    rows = {r.doc_id: r for r in quality(docs, clean_col="clean").collect()}
    assert [i for i in rows if rows[i].kept] and {i for i in rows if rows[i].kept} == {4, 7, 8, 11, 13, 14, 15}
    assert rows[7].n_navigation == 1 and "Home |" not in rows[7].clean
    assert rows[8].n_boilerplate == 1 and "Cookie" not in rows[8].clean
    assert rows[4].clean == TEXTS[4] and rows[0].clean is None
    assert quality(docs.limit(0)).count() == 0
    assert all(p == p.lower() for p in BOILERPLATE)


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", quality_digest(docs)._jdf.queryExecution().executedPlan().toString())


def test_clashing_columns_repeated_rows_and_null_ids(spark):
    rows = [(None, TEXTS[4]), (1, TEXTS[4]), (1, TEXTS[4]), (2, None), (None, None)]
    docs = spark.createDataFrame([(*x, "a", "b", 7, 8) for x in rows], "doc_id long, text string, _made string, _one string, kept int, _q int")
    out = quality(docs, clean_col="clean").collect()
    assert len(out) == 5 and all((r._made, r._one, r._q) == ("a", "b", 8) for r in out) and len({(r.n_words, r.kept) for r in out if r.text}) == 1
    assert [r.n_words for r in out if r.text is None] == [0, 0]
