"""Which files of a table may hold what a full-text query asks for.

A postings table has a row for each token of each file and field, sorted by token, with Bloom filters: a lookup reads the
few row groups that may have its tokens. The query itself is evaluated once more over what each file has: a phrase needs all
its tokens in one field, & and | are as they are, and ~ excludes no file, since a file that holds a token has other rows too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.fts import TOKENS, query_tokens

POSTINGS = "field string, token string, batch long, file string, rows long"
_OPTIONS = {"parquet.bloom.filter.enabled#token": "true", "parquet.bloom.filter.max.bytes": str(1 << 20), "parquet.block.size": str(32 << 20)}


class May:
    """A condition on a file that all files with a matching row meet."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: May) -> May:
        return May(self.column & other.column)

    def __or__(self, other: May) -> May:
        return May(self.column | other.column)

    def __invert__(self) -> May:
        return May(F.lit(True))


@dataclass(frozen=True)
class FileFields:
    """The same conditions as fts.Fields, over a file's `found` (field, token) of the tokens that were asked for."""

    names: tuple[str, ...]
    asked: list[tuple[str, bool]] = field(default_factory=list)

    def only(self, *names: str) -> FileFields:
        return FileFields(tuple(names), self.asked)

    def but(self, *names: str) -> FileFields:
        return FileFields(tuple(n for n in self.names if n not in names), self.asked)

    def has(self, phrase: str, prefix: bool = False, first: bool = False) -> May:
        tokens = query_tokens(phrase)
        if not tokens:
            return May(F.lit(True))
        whole = tokens[:-1] if prefix else tokens
        self.asked.extend([(t, False) for t in whole] + [(t, True) for t in tokens[len(whole) :]])

        def there(name, token, open_end):
            return F.exists("found", lambda x: (x["field"] == name) & (F.startswith(x["token"], F.lit(token)) if open_end else x["token"] == token))

        out = F.lit(False)
        for n in self.names:
            have = F.lit(True)
            for k, t in enumerate(tokens):
                have = have & there(n, t, prefix and k == len(tokens) - 1)
            out = out | have
        return May(out)

    def near(self, phrases: list[str], distance: int = 10) -> May:
        out = May(F.lit(False))
        for n in self.names:
            have = May(F.lit(True))
            for p in phrases:
                have = have & self.only(n).has(p)
            out = out | have
        return out

    def all_of(self, terms: list[str]) -> May:
        out = May(F.lit(True))
        for t in terms:
            if not (t.startswith("-") and len(t) > 1):
                out = out & self.has(t.removesuffix("*"), prefix=t.endswith("*"))
        return out


def postings(rows: DataFrame, *names: str) -> DataFrame:
    """A row for each token of each file (batch, file) and field, from token columns; files meet in their tasks first."""

    def of(name):
        tokens = F.array_distinct(F.split(F.trim(F.col(name + TOKENS)), " "))  # of texts: of structs it would compare all pairs
        return F.transform(tokens, lambda t: F.struct(F.lit(name).alias("field"), t.alias("token")))

    each = rows.select("batch", "file", F.explode(F.concat(*map(of, names))).alias("x")).select("batch", "file", "x.*").where("token <> ''")
    return each.groupBy("field", "token", "batch", "file").agg(F.count("*").alias("rows"))


def write_postings(found: DataFrame, path: str) -> None:
    found.repartitionByRange("token").sortWithinPartitions("token", "field", "file").write.options(**_OPTIONS).mode("append").parquet(path)


def files_of(table: DataFrame, query: Callable[[FileFields], May] | list[str], names: tuple[str, ...]) -> DataFrame | None:
    """batch, file of the files that may hold a match; None where every file may, as for exclusions alone."""
    fields = FileFields(names)
    may = query(fields) if callable(query) else fields.all_of(query)
    nothing = table.sparkSession.range(1).select(F.array().cast("array<struct<field: string, token: string>>").alias("found"))
    if nothing.where(may.column).count():
        return None
    wanted = F.col("token").isin(sorted({t for t, prefix in fields.asked if not prefix}))
    for t in sorted({t for t, prefix in fields.asked if prefix}):
        wanted = wanted | F.startswith("token", F.lit(t))
    have = table.where(wanted & F.col("field").isin(list(names))).groupBy("batch", "file").agg(F.collect_set(F.struct("field", "token")).alias("found"))
    return have.where(may.column).select("batch", "file")
