"""Benchmark items in documents, up to a share of edits.

Texts are compared in lower case with runs of ASCII marks and white space as one space. An item of m characters
may differ by k = m * percent // 100 edits; it is cut into k + 1 pieces, and by the pigeonhole principle one of
them stands unchanged wherever the item does. One pass of an automaton over a text finds all pieces of all items.
The same principle holds for groups of pieces: of p pieces with p - 1 edits or fewer, one half has fewer edits than
pieces. So a piece's place counts only if the piece beside it stands there with one edit at most, and the four
pieces around it with three; of one edit, half the piece is free, which a substring test settles mostly. Around
the places that are left, Myers' bit-parallel algorithm gives the least number of edits of the whole item.

The items come by the driver and are broadcast in blocks of BLOCK_CHARS characters, however many they are; a larger
benchmark takes more passes over the documents. Documents are never shuffled.

Defined cases: a null or empty text, or one without letters and digits, holds nothing; items with the same text
are each reported; items too short for an edit (under ten characters at ten per cent) must be found unchanged and as whole words; empty and
null items are in no document; repeated rows are reported each, also those without an id; empty tables give no rows;
other columns are ignored. doc_id and item_id are integers (long).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import written

PERCENT = 10
BLOCK_CHARS = 8 << 20
_PLAIN = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def plain(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "surrogatepass")


class Masks:
    """A string's bit masks; search gives the fewest edits at which it ends somewhere in a text, and that end."""

    def __init__(self, item: str):
        self.text, self.m = item, len(item)
        self.places: dict[str, int] = {}
        for i, c in enumerate(item):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        ones, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, edits, best, end = ones, 0, self.m, self.m, 0
        get = self.places.get
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            more = down | ~(horizontal | up)
            less = up & horizontal
            if more & top:
                edits += 1
            elif less & top:
                edits -= 1
                if edits < best:
                    best, end = edits, i
            more <<= 1
            up = ((less << 1) | ~(vertical | more)) & ones
            down = more & vertical & ones
        return best, end


class Pattern(Masks):
    """One item, its pieces, and the groups of four pieces."""

    def __init__(self, item: str, percent: int):
        super().__init__(item)
        self.k = self.m * percent // 100
        n = self.k + 1
        self.cuts = [i * self.m // n for i in range(n + 1)]
        self.fours = [(self.cuts[i], min(4, n - i) - 1, Masks(item[self.cuts[i] : self.cuts[min(i + 4, n)]])) for i in range(0, n, 4)]

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece) of k + 1 pieces."""
        return [(a, self.text[a:b]) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def beside(self, i: int) -> tuple[int, int, str | None, str | None]:
        """Where the piece beside piece i lies from i's start, with an edit, and its halves; no halves without such a piece."""
        j = i ^ 1
        if j > self.k:
            return 0, 0, None, None
        own, other = self.cuts[i + 1] - self.cuts[i], self.text[self.cuts[j] : self.cuts[j + 1]]
        n, half = len(other), len(other) // 2
        return (own - 1, own + n + 2, other[:half], other[half:]) if j > i else (-n - 2, 1, other[:half], other[half:])

    def four_stand(self, i: int, text: str, start: int) -> bool:
        """Whether the group of four of piece i is at its place in a text where the item would start at `start`."""
        offset, edits, masks = self.fours[i // 4]
        a = max(0, start + offset - edits - 3)
        return masks.search(text[a : start + offset + masks.m + edits + 3])[0] <= edits


def found_in(text: str, automaton, patterns: dict) -> dict:
    """item -> (edits, end) of its best place in a plain text."""
    at: dict = {}
    for end, owners in automaton.iter(text):
        for item, i, offset, n, lo, hi, left, right in owners:
            start = end + 1 - n
            if left is not None:
                beside = text[max(0, start + lo) : start + hi]
                if left not in beside and right not in beside:
                    continue
            at.setdefault(item, set()).add((start - offset, i))
    out = {}
    for item, found in at.items():
        p = patterns[item]
        starts = sorted({s for s, i in found if not p.k or p.four_stand(i, text, s)})
        if not starts:
            continue
        exact = text.find(p.text)
        if exact >= 0 and (p.k or f" {p.text} " in f" {text} "):
            out[item] = (0, exact + p.m)
            continue
        if not p.k:
            continue
        low = high = starts[0]
        for s in starts[1:]:
            if s > high + 1:
                _look(p, text, low, high, item, out)
                low = s
            high = s
        _look(p, text, low, high, item, out)
    return out


def _look(p: Pattern, text: str, low: int, high: int, item, out: dict) -> None:
    a = max(0, low - p.k)
    edits, end = p.search(text[a : high + p.m + p.k])
    if edits <= p.k and (item not in out or edits < out[item][0]):
        out[item] = (edits, a + end)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    block, chars = {}, 0
    for i, r in enumerate(benchmark.select(item_col, text_col).toLocalIterator()):
        if text := plain(r[1]):
            block[i] = (r[0], text)
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield block
                block, chars = {}, 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, end (in the plain text): a row for each item that a document holds, at its best place."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, end long"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import ahocorasick

            patterns = {key: Pattern(text, percent) for key, (_, text) in shared.value.items()}
            pieces: dict[str, list] = {}
            for key, p in patterns.items():
                for i, (offset, piece) in enumerate(p.pieces()):
                    pieces.setdefault(piece, []).append((key, i, offset, len(piece), *p.beside(i)))
            automaton = ahocorasick.Automaton()
            for piece, owners in pieces.items():
                automaton.add_word(piece, owners)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for key, (edits, end) in found_in(plain(text.as_py()), automaton, patterns).items():
                        rows.append((doc_id, shared.value[key][0], edits, end))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "edits", "end"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that hold an item; rows with a null id stay."""
    leaks = written(contaminated(docs, benchmark, percent).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti")
