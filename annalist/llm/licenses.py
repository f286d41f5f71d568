"""License notices in documents.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased; a text is looked through as its
words with a space between. Base: the places where a phrase's words stand one after another. Short notices are
found with edits: a notice of m characters may differ by k = m * percent // 100; it is cut into k + 1 seeds of which
one stands unchanged, an automaton finds all seeds in one pass, a bit-parallel distance drops the windows that
can't match, and the regex library's bounded-error matching verifies the others and gives the span and its edits.

score: 1 for a base phrase; else for the best notice one minus its edits over its length; 0 without any.

Defined cases: a null text counts as empty (no words, no labels, score 0); places may overlap; repeated rows get
a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.decontaminate import Masks

PERCENT = 12
#: Phrase and label, as the contract gives them.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices of public licenses, as words, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl-3"),
    ("subject to the terms of the mozilla public license", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "reserved"),
)
_WORDS = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"


class Notices:
    def __init__(self, notices=NOTICES, percent: int = PERCENT):
        import ahocorasick

        self.notices, seeds = [], {}
        for n, (text, label) in enumerate(notices):
            k = len(text) * percent // 100
            cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((n, a, b - a))
            self.notices.append((label, Masks(text), k))
        self.patterns: dict = {}
        self.seeds = ahocorasick.Automaton()
        for seed, owners in seeds.items():
            self.seeds.add_word(seed, owners)
        self.seeds.make_automaton()

    def _found(self, n: int, edits: int, text: str, low: int, high: int):
        """The first match of a notice with so many edits, by the regex library."""
        import regex

        if (n, edits) not in self.patterns:
            notice = regex.escape(self.notices[n][1].text, special_only=True)
            self.patterns[n, edits] = regex.compile(rf"\b(?:{notice}){{e<={edits}}}\b" if edits else rf"\b{notice}\b")
        return self.patterns[n, edits].search(text, low, high)

    def spans(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length) of the notices in a text of words, the best of overlapping places."""
        seen: dict[int, set] = {}
        for end, owners in self.seeds.iter(text):
            for n, offset, size in owners:
                seen.setdefault(n, set()).add(end + 1 - size - offset)
        found = []
        for n, places in seen.items():
            label, masks, k = self.notices[n]
            past = -1
            for s in sorted(places):
                if s + masks.m + k <= past:
                    continue
                low, high = max(0, s - k - 1), s + masks.m + k + 1
                # the fewest edits without regard to word ends; the pattern is tried from there on
                for edits in range(masks.search(text[low:high])[0], k + 1):
                    if (hit := self._found(n, edits, text, low, high)) is not None:
                        found.append((label, hit.start(), hit.end(), sum(hit.fuzzy_counts), masks.m))
                        past = hit.end()
                        break
        starts, best = [], []  # both in order of place; what is kept doesn't overlap, so only neighbours can be in the way
        for x in sorted(found, key=lambda x: (x[3] / x[4], -x[4], x[1], x[0])):
            k = bisect.bisect_left(starts, x[1])
            if (k == 0 or best[k - 1][2] <= x[1]) and (k == len(best) or x[2] <= best[k][1]):
                starts.insert(k, x[1])
                best.insert(k, x)
        return best


def base_places(text: str) -> list[tuple[int, str]]:
    """(word, label) of every place of a phrase."""
    framed, out = f" {text} ", []
    for phrase, label in PHRASES:
        at, last, word = framed.find(f" {phrase} "), 0, 0
        while at >= 0:
            word += framed.count(" ", last, at)  # words since the place before
            out.append((word, label))
            last, at = at, framed.find(f" {phrase} ", at + 1)
    return out


def in_words(text: str, spans) -> list[dict]:
    """Spans (label, start, end, edits, length), in order and apart, with the numbers of their first and last words."""
    out, last, word = [], 0, 0
    for label, start, end, edits, _ in spans:
        word += text.count(" ", last, start)
        out.append({"label": label, "first_word": word, "last_word": word + text.count(" ", start, end - 1), "edits": edits})
        last = start
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def run(batches):
        notices = Notices()
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (cell.as_py() or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
                text = b" ".join(words).decode("utf-8", "surrogatepass")
                places, spans = base_places(text), notices.spans(text)
                base = sorted({x[1] for x in places})
                labels = sorted({*base, *(x[0] for x in spans)})
                score = 1.0 if places else max((1 - x[3] / x[4] for x in spans), default=0.0)
                at = [x[0] for x in places]
                told = in_words(text, spans)
                rows.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score, told))
            span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
