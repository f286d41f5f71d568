"""Line-first quality rules, with DataFrame functions only.

Each line that has a word is held against three rules; lines that fail one are removed:
- punctuation: of its characters that aren't white space, over a tenth are symbols (#*$%&|<>), or it has two
  words for each doubled ! or ? or fewer, or no letter or digit at all;
- navigation: three separators or more (| • · » › or > between spaces), with at most four words for each;
- boilerplate: it is short (40 words or fewer) and holds a phrase that sites put around their texts.
A document is rejected if it fails the base limits (under 50 words, or over half of its words in three-word
windows that occur twice or more), or if the removed lines hold over MOST_LOST per cent of its characters
outside white space.

Defined cases: a null text counts as empty: no words, so rejected; blank lines are neither kept nor lost;
repeated rows, and rows without an id, each get their verdict; an empty table gives no rows; other columns are left as
they are, unless they have the name of one that is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import WORD, free_name

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 30
SEPARATORS = "|•·»›"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "click here", "read more", "sign in", "log in to", "sign up", "subscribe to", "enable javascript", "powered by",
    "skip to content", "share this", "follow us on", "lorem ipsum", "back to top", "add to cart",
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three words that is found twice or more."""

    def covered(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(ordered, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def line_rule(line: Column) -> Column:
    """The rule that a line with a word fails, or null."""
    dense = F.length(_without(line, SPACES))
    separators = _count(line, SEPARATORS) + F.regexp_count(line, F.lit(" > "))
    low = F.lower(line)
    phrase = F.lit(False)
    for x in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(x))
    punctuation = (_count(line, SYMBOLS) * 10 > dense) | (F.contains(line, F.lit("!!")) | F.contains(line, F.lit("??"))) & (F.regexp_count(line, F.lit(r"[!?]{2,}")) * 2 >= n_words(line)) | ~line.rlike(r"[\p{L}\p{N}]")
    navigation = (separators >= 3) & (n_words(line) <= separators * 5)
    return F.when(navigation, "navigation").when(punctuation, "punctuation").when(phrase & (n_words(line) <= 40), "boilerplate")


def _fails(judged: Column, rule: str) -> Column:
    return F.size(F.filter(judged, lambda y: y["rule"] == rule))


def quality(docs: DataFrame, most_lost: int = MOST_LOST, text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and what was removed.

    clean_col: adds the text without the removed lines (the text itself if none is removed).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = _let(lines, lambda x: F.transform(x, lambda y: F.struct(line_rule(y).alias("rule"), F.length(_without(y, SPACES)).alias("chars"))))
    made, one = free_name(docs, "_made"), free_name(docs, "_one")
    first = docs.select(
        "*",
        F.struct(
            F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("words"),
            _let(judged, lambda j: F.struct(
                F.size(j).alias("lines"),
                *(_fails(j, k).alias(k) for k in ("punctuation", "navigation", "boilerplate")),
                F.aggregate(j, F.lit(0), lambda a, y: a + F.when(y["rule"].isNotNull(), y["chars"]).otherwise(0)).cast("long").alias("lost"),
            )).alias("removed"),
        ).alias(made),
    )
    # a generator keeps the struct from being computed once for each of its fields
    first = first.withColumn(one, F.explode(F.array(made))).drop(made)
    q = F.col(one)
    base = (q["words"]["n"] < LEAST_WORDS) | (q["words"]["repeated"] * 100 > q["words"]["n"] * MOST_REPEATED)
    out = {
        "n_words": q["words"]["n"],
        "word_chars": q["word_chars"],
        "n_symbols": q["n_symbols"],
        "n_dup_lines": q["n_dup_lines"],
        "n_repeat_words": q["words"]["repeated"],
        "base_failed": base,
        "kept": ~base & (q["removed"]["lost"] * 100 <= q["word_chars"] * most_lost),
        "n_lines": q["removed"]["lines"],
        "n_punctuation": q["removed"]["punctuation"],
        "n_navigation": q["removed"]["navigation"],
        "n_boilerplate": q["removed"]["boilerplate"],
        "lost_chars": q["removed"]["lost"],
    }
    if clean_col:
        clean = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_rule(x).isNull()), "\n")
        out[clean_col] = F.when(q["removed"]["lost"] > 0, clean).otherwise(F.col(text_col))
    clash = [c for c in docs.columns if c in out and c != clean_col]
    return first.drop(*clash).withColumns(out).drop(one)


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars"]

_PHRASES = " or ".join(f"contains(low, '{x}')" for x in BOILERPLATE)
ORACLE = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
tri as (select k, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as t from w, lateral (select unnest(range(1, len(words) - 1)) as i)),
twice as (select k, i from (select k, i, count(*) over (partition by k, t) as n from tri) where n > 1),
covered as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from twice) group by k),
l as (select k, x, lower(x) as low, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) as chars,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n,
    length(x) - length(translate(x, '|•·»›', '')) + len(regexp_extract_all(x, ' > ')) as sep,
    length(x) - length(translate(x, '#*$%&|<>', '')) as sym, len(regexp_extract_all(x, '[!?]{{2,}}')) as loud
  from (select k, unnest(string_split(text, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
r as (select k, x, chars, case when sep >= 3 and n <= sep * 5 then 'navigation'
    when sym * 10 > chars or (loud > 0 and loud * 2 >= n) or not regexp_matches(x, '[\p{{L}}\p{{N}}]') then 'punctuation'
    when n <= 40 and ({_PHRASES}) then 'boilerplate' end as rule from l),
s as (select k, count(*) as lines, count(*) - count(distinct x) as dups, count(*) filter (rule = 'punctuation') as p,
    count(*) filter (rule = 'navigation') as nav, count(*) filter (rule = 'boilerplate') as b,
    coalesce(sum(chars) filter (rule is not null), 0) as lost from r group by k),
j as (select doc_id, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(dups, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
    coalesce(lines, 0) as n_lines, coalesce(p, 0) as n_punctuation, coalesce(nav, 0) as n_navigation, coalesce(b, 0) as n_boilerplate, coalesce(lost, 0) as lost_chars
  from w left join covered using (k) left join s using (k))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars * 100 <= word_chars * {MOST_LOST} as kept,
  cast(n_lines as integer) as n_lines, cast(n_punctuation as integer) as n_punctuation, cast(n_navigation as integer) as n_navigation,
  cast(n_boilerplate as integer) as n_boilerplate, cast(lost_chars as bigint) as lost_chars
from j
"""


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text")).select(*DIGEST)
