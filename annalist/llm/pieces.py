"""Texts cut at places that no match of a byte-level BPE pattern crosses.

A single space between two other characters always starts a new match and belongs to it, so the tokens of a
text are those of its pieces in turn. A piece is then looked up once for many occurrences.
"""

from __future__ import annotations

import re

#: White space beside a space, or a space at the end: there, only places between two other characters are cut.
_BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_BLANK = re.compile(r"\s").search
_RARE = re.compile(r"[^\S \n\t\r]")
_RARE_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"


def _rare(text: str) -> bool:
    return any(x in text for x in _RARE_ASCII) if text.isascii() else _RARE.search(text) is not None
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def cut(text: str) -> list[str]:
    """The first piece as it is; of each later one the space before it is left out, unless it has none.

    Later pieces all start with one space in the text: the text is pieces[0] + ' ' + pieces[1] + ' ' + ...
    """
    if not (text.endswith(" ") or any(x in text for x in _BESIDE) or _rare(text)):
        return text.split(" ")
    first, *rest = _SAFE.split(text)
    return [first, *(x[1:] for x in rest)]


def slices(sizes, most: int = 1 << 20):
    """Index ranges of rows with about `most` characters together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: The pattern of the byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Marks after letters are one match, up to the end of a piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def matcher(pattern: str = BYTE_LEVEL):
    """A function that gives the pattern's matches of a piece; most pieces are letters and maybe marks after them."""
    import regex

    find = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return find

    def matches(piece: str) -> list[str]:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            return [piece]
        bare = word.rstrip(MARKS)
        if bare.isalpha():
            n = len(word) - len(bare)
            return [piece[:-n], piece[-n:]]
        first, *lines = word.split("\n")
        if lines and first and all(lines) and not _BLANK(first) and not any(map(_BLANK, lines)):  # a line end is a match of its own
            out = matches(piece[: len(piece) - len(word)] + first)
            for x in lines:
                out = [*out, "\n", *matches(x)]
            return out
        return find(piece)

    return matches


class Recent(dict):
    """A cache of bounded size: what wasn't used since it was half full last goes first."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def absent(self, keys) -> list:
        """The keys that must be computed; older ones are taken over."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
        out, old = [], self.old
        for k in keys:
            if k not in self:
                if k in old:
                    self[k] = old[k]
                else:
                    out.append(k)
        return out


class Kept(dict):
    """A cache that computes what it lacks. trim() bounds it: what wasn't used since it was half full last goes first."""

    def __init__(self, most: int, new):
        super().__init__()
        self.half, self.old, self.new = most // 2, {}, new

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.new(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
