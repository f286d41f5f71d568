"""Full-text conditions as Spark columns.

Tokens are runs of letters and digits in lower case without diacritics. A phrase is found in a column in one of two ways:
- in a token column that the store's writer keeps (token_text: one space between and around tokens) as a substring;
- else in the text itself, by a pattern that takes every letter with its cases and accents and needs whole tokens.
Both are built-in expressions; nothing is tokenised at search time. Conditions are combined with &, | and ~ as any
columns; a list of terms as a user types them is taken by Fields.all_of.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The store keeps the tokens of a text column beside it under this ending.
TOKENS = "_tokens"
TOKEN = r"([\p{L}\p{N}\p{Co}]+)"
_IN = r"[\p{L}\p{N}\p{Co}]"


def _folds() -> tuple[str, str]:
    """Letters with diacritics below U+0250 and what is left of them."""
    pairs = []
    for n in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(n).lower())[0]
        if chr(n).isalpha() and plain != chr(n) and plain.isascii() and plain.isalpha():
            pairs.append((chr(n), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTS, PLAIN = _folds()


def _folded(text: str) -> str:
    table = str.maketrans(ACCENTS, PLAIN)
    return text.translate(table).lower().translate(table)


@functools.cache
def _variants() -> dict[str, str]:
    """A folded letter and all characters of the first plane that fold to it."""
    out: dict[str, str] = {}
    for n in range(0x80, 0x10000):
        if not 0xD800 <= n < 0xE000 and (f := _folded(chr(n))) != chr(n) and len(f) == 1:
            out[f] = out.get(f, "") + chr(n)
    return out


def token_text(c: Column) -> Column:
    """' token token ... ' of a text."""
    folded = F.translate(F.lower(F.translate(F.coalesce(c, F.lit("")), ACCENTS, PLAIN)), ACCENTS, PLAIN)
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(1)), " "), F.lit(" "))


def with_tokens(df: DataFrame, *columns: str) -> DataFrame:
    """df with a token column beside each text column, as the store's writer keeps it."""
    return df.withColumns({c + TOKENS: token_text(F.col(c)) for c in columns})


def query_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", _folded(text))


def _pattern(tokens: list[str], prefix: bool, first: bool) -> str:
    """A pattern of whole tokens with anything but letters and digits between them."""

    def letter(c):
        others = _variants().get(c, "")
        both = c + (c.upper() if len(c.upper()) == 1 and c.upper() != c and c.upper() not in others else "") + others
        return re.escape(c) if len(both) == 1 else "[" + both + "]"

    body = rf"(?:(?!{_IN})[\s\S])+".join("".join(map(letter, t)) for t in tokens)
    before = rf"\A(?:(?!{_IN})[\s\S])*" if first else rf"(?<!{_IN})"
    return before + body + ("" if prefix else rf"(?!{_IN})")


@dataclass(frozen=True)
class Fields:
    """The text columns that a search looks at: name -> text column, or its token column where `kept` says so."""

    columns: dict[str, Column]
    kept: frozenset[str] = frozenset()

    def only(self, *names: str) -> Fields:
        if unknown := [n for n in names if n not in self.columns]:
            raise ValueError(f"no such column: {', '.join(unknown)}; known: {', '.join(self.columns)}")
        return Fields({n: self.columns[n] for n in names}, self.kept)

    def but(self, *names: str) -> Fields:
        self.only(*names)
        return self.only(*(n for n in self.columns if n not in names))

    def has(self, phrase: str, prefix: bool = False, first: bool = False) -> Column:
        """Whether a column has the phrase's tokens one after another; prefix: the last one may go on; first: at the start.

        A phrase without a token is no condition: it is met.
        """
        tokens = query_tokens(phrase)
        if not tokens:
            return F.lit(True)
        text, pattern = " " + " ".join(tokens) + ("" if prefix else " "), _pattern(tokens, prefix, first)
        out = F.lit(False)
        for n, c in self.columns.items():
            if n in self.kept:
                found = F.startswith(c, F.lit(text)) if first else F.contains(c, F.lit(text))
            else:
                found = F.coalesce(c.rlike(pattern), F.lit(False))
            out = out | found
        return out

    def near(self, phrases: list[str], distance: int = 10) -> Column:
        """Whether one column has all phrases with at most `distance` tokens between the first's end and the last's start."""
        wanted = [t for p in phrases if (t := query_tokens(p))]
        out = F.lit(not wanted)
        for n, c in self.columns.items():
            if wanted:
                one = Fields({n: c}, self.kept)
                have = F.lit(True)
                for t in wanted:  # rows without all of them are settled by this alone
                    have = have & one.has(" ".join(t))
                tokens = c if n in self.kept else token_text(c)
                out = out | F.when(have, _let(F.split(F.trim(tokens), " "), lambda w: _near(w, wanted, distance))).otherwise(False)
        return out

    def all_of(self, terms: list[str]) -> Column:
        """All of a user's terms: x, "a phrase", x* as a prefix, -x to exclude. Exclusions alone find nothing."""
        wanted = [t for t in terms if not (t.startswith("-") and len(t) > 1)]
        out = F.lit(bool(wanted) and any(query_tokens(t) for t in wanted))
        for t in wanted:
            out = out & self.has(t.removesuffix("*"), prefix=t.endswith("*"))
        for t in terms:
            if t.startswith("-") and query_tokens(t):
                out = out & ~self.has(t[1:].removesuffix("*"), prefix=t.endswith("*"))
        return out


def fields(df: DataFrame, *names: str) -> Fields:
    """The text columns of df by name, or the token columns that are kept beside them."""
    kept = frozenset(n for n in names if n + TOKENS in df.columns)
    return Fields({n: F.col(n + TOKENS if n in kept else n) for n in names}, kept)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(tokens: list[str], words: Column) -> Column:
    """Positions of a phrase among the words of a text."""

    def here(i):
        ok = F.lit(True)
        for k, t in enumerate(tokens):
            ok = ok & (F.get(words, i + k) == t)
        return F.coalesce(ok, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)


def _near(words: Column, phrases: list[list[str]], distance: int) -> Column:
    most = distance + sum(map(len, phrases))
    first, *others = [(_starts(t, words), len(t)) for t in phrases]
    spans = F.transform(first[0], lambda s: F.struct(s.alias("lo"), (s + first[1]).alias("hi")))
    for starts, size in others:
        spans = _joined(spans, starts, size)
    return F.exists(spans, lambda a: a["hi"] - a["lo"] <= most)


def _joined(spans: Column, starts: Column, size: int) -> Column:
    def with_start(a):
        return F.transform(starts, lambda s: F.struct(F.least(a["lo"], s).alias("lo"), F.greatest(a["hi"], s + size).alias("hi")))

    return F.flatten(F.transform(spans, with_start))  # places of a phrase times places of the next, within one text
