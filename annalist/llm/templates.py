r"""Recurring lines across documents, by a template tree of fixed depth.

Units are lines of LEAST_TOKENS tokens or more, and the sentences of LEAST_SENTENCE tokens or more of lines over
LONG_LINE tokens, so that a passage inside a long line is found too. A unit's tokens that hold a digit or an @ are
variable fields and become <*>, unless most of its tokens do; that is the unit's form. The tree has three levels: the
number of tokens, the leading DEPTH tokens, and the leaf's forms.

In a leaf of MIN_DOCS documents or more, forms of SHORTEST tokens or more are generalised. A form belongs to another one that agrees with it in SIMILAR
per cent of their positions, so the rest of its tokens, cut into one segment more than positions may differ, has a
segment in common with it. Under each segment of a leaf stands the form of most documents (of equals, the one that comes
first); a form's candidates are those of its segments. A template is a form that has no better candidate; another form
belongs to the best template among its candidates, and stands for itself without one. All forms of a leaf are looked at,
whatever their number or length.

A template of MIN_DOCS documents or more is recurring: its lines are dropped from all documents but the first (the
smallest doc_id), and so are its sentences from the lines that stay.

Units are cut from texts in Arrow batches. All other steps are sums and joins on segment, form, template or document. Rows of a common key are summed in tasks first and
stay where they are in joins; those of a common candidate are split by adaptive execution.
Defined cases: null and empty texts have no lines; a line that a document repeats counts once for it; rows with the same
doc_id are the same document; a null doc_id loses no lines; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import FEW, with_key_row, written
from annalist.llm.pieces import slices

LEAST_TOKENS = 4
LEAST_SENTENCE = 8
LONG_LINE = 50
DEPTH = 3
SHORTEST = 6
SIMILAR = 70
MIN_DOCS = 3
SENTENCE = r"(?s).*?[.!?][\x20\x09-\x0D]+|.+"
BETWEEN = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+").split
FIELD = re.compile(rb"[0-9@]").search
NO_WORD = r"[^\x20\x09-\x0D]"
FORM = ["leaf", "form"]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def masked(t: list[bytes]) -> list[bytes]:
    """Tokens that hold a digit or an @ become <*>, unless most do."""
    fields = [b"<*>" if FIELD(x) else x for x in t]
    return fields if 2 * sum(1 for x in t if FIELD(x)) <= len(t) else t


def sentences(line: Column) -> Column:
    """The texts of a line's sentences with the white space after them: a token that ends in . ! or ? ends one."""
    return F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0))


def line_units(text: bytes):
    """at (line number from 0), part (sentence from 0, or -1), n, head (n and the leading tokens), form: the units of a text."""
    for at, line in enumerate(text.split(b"\n")):
        t = line.split()
        size = len(t)
        if size < LEAST_TOKENS:
            continue
        fields = FIELD(line)
        m = masked(t) if fields else t
        yield at, -1, size, b"%d %b" % (size, b" ".join(m[:DEPTH])), b" ".join(m)
        if size > LONG_LINE:
            for part, sentence in enumerate(BETWEEN(line)):
                t = sentence.split()
                n = len(t)
                if n >= LEAST_SENTENCE:
                    m = masked(t) if fields else t
                    yield at, part, n, b"%d %b" % (n, b" ".join(m[:DEPTH])), b" ".join(m)


def line_forms(docs: DataFrame) -> DataFrame:
    """doc_id, at (line number from 0), part (sentence from 0, or -1), n, leaf, form, masked (if it can be generalised)."""

    def run(batches):
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices([len(x or b"") for x in texts], 4 << 20):
                found = [(k, *unit) for k in range(i, j) if texts[k] for unit in line_units(texts[k])]
                if not found:
                    continue
                row, at, part, n, head, form = zip(*found, strict=True)
                keys = [pa.array(np.fromiter(map(hashed, x), np.uint64, len(x)).view(np.int64)) for x in (head, form)]
                shown = pa.array([x if k >= SHORTEST else None for x, k in zip(form, n, strict=True)], pa.binary()).view(pa.string())
                columns = [ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (at, part, n)), *keys, shown]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "part", "n", "leaf", "form", "masked"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at int, part int, n int, leaf long, form long, masked string")


def _segments(masked: Column, n: Column, leaf: Column) -> Column:
    """A key for each segment of a form's tokens after the leading ones."""
    parts = F.floor(n * (100 - SIMILAR) / 100).cast("int") + 1

    def cut(i):
        return (F.lit(DEPTH) + F.floor(i * (n - DEPTH) / parts)).cast("int")

    return _let(F.split(masked, " "), lambda t: F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64(leaf, i, F.slice(t, cut(i) + 1, cut(i + 1) - cut(i)))))


def templates(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """leaf, form, template, size (units of the form): the forms that belong to a template of another form.

    Leaves of fewer than min_docs documents hold nothing that recurs and are left out.
    """
    # Sums of plain numbers only, so that they are hashed and not sorted; where a form first stands is looked up for shared ones.
    of_docs = lines.where("masked is not null").groupBy(*FORM, "n", "doc_id").agg(F.count("*").alias("units"))
    born = F.when(~F.bool_or(F.col("doc_id").isNull()), F.min("doc_id")).alias("born")  # of null ids first, as in a struct's order
    forms = of_docs.groupBy(*FORM, "n").agg(F.count("doc_id").alias("docs"), F.sum("units").alias("size"), born)
    forms = written(forms, "line-forms")
    several = forms.groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("docs").alias("all")).where((F.col("forms") > 1) & (F.col("all") >= min_docs)).select("leaf", "forms")
    shared = written(with_key_row(forms, several, "leaf", "forms", forms.count()), "line-shared")
    ids = shared.select(*FORM, F.col("born").alias("doc_id"))
    ids = F.broadcast(ids) if shared.count() <= FEW else ids  # else the texts of all lines would move
    is_first = [lines[c].eqNullSafe(ids[c]) for c in (*FORM, "doc_id")]
    texts = lines.join(ids, is_first, "left_semi").groupBy(*FORM).agg(F.min(F.struct("at", "part", "masked")).alias("m"))
    rank = F.struct("docs", (-F.col("born")).alias("doc"), (-F.col("m.at")).alias("at"), (-F.col("m.part")).alias("part"), "form")
    shared = written(shared.join(texts, FORM).select(*FORM, "n", "size", rank.alias("rank"), "m.masked"), "line-texts")

    keys = shared.select(*FORM, "rank", F.explode(_segments(F.col("masked"), F.col("n"), F.col("leaf"))).alias("key"))
    total = shared.agg(F.sum(F.floor(F.col("n") * (100 - SIMILAR) / 100) + 1)).first()[0] or 0
    tops = keys.groupBy("key").agg(F.max("rank").alias("top"), F.count("*").alias("count")).where("count > 1")
    found = with_key_row(keys.select(*FORM, "key"), tops, "key", "count", total)
    pairs = found.where("form <> top.form").select(*FORM, "top").distinct()

    mine = pairs.join(shared.select(*FORM, "n", "size", F.col("masked").alias("mine")), FORM).withColumn("template", F.col("top.form"))
    both = mine.join(shared.select("leaf", F.col("form").alias("template"), F.col("masked").alias("other")), ["leaf", "template"])
    agree = F.size(F.filter(F.zip_with(F.split("mine", " "), F.split("other", " "), lambda a, b: a == b), lambda x: x))
    alike = written(both.where(agree * 100 >= F.col("n") * SIMILAR).select(*FORM, "size", "template", "top"), "line-pairs")
    members = alike.select("leaf", F.col("form").alias("template")).distinct()
    return alike.join(members, ["leaf", "template"], "left_anti").groupBy(*FORM).agg(F.max("top").alias("top"), F.max("size").alias("size")).select(*FORM, F.col("top.form").alias("template"), "size")


def recurring_units(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, at, part: lines (part -1) to drop, and sentences to drop from other lines; docs has doc_id and text."""
    lines = written(line_forms(docs), "lines")
    total = lines.count()
    mapped = with_key_row(lines.select("doc_id", "at", "part", *FORM), written(templates(lines, min_docs), "templates"), FORM, "size", total, "left", FEW)
    mapped = written(mapped.select("doc_id", "at", "part", "leaf", F.coalesce("template", "form").alias("template")), "line-templates")
    of = ["leaf", "template"]
    counts = mapped.groupBy(*of, "doc_id").agg(F.count("*").alias("n")).groupBy(*of).agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first"), F.sum("n").alias("units"))
    counts = written(counts.where(F.col("docs") >= min_docs).select(*of, "first", "units"), "line-counts")
    return with_key_row(mapped, counts, of, "units", total, few=FEW).where("doc_id > first").select("doc_id", "at", "part")


def _to_drop(docs: DataFrame, min_docs: int) -> DataFrame:
    """id, lines (numbers), cuts (line, sentence) of documents that lose some; a sentence of a dropped line isn't told."""
    rows = recurring_units(docs.select("doc_id", "text"), min_docs).groupBy("doc_id").agg(F.collect_set(F.struct("at", "part")).alias("all"))
    lines = F.transform(F.filter("all", lambda x: x["part"] < 0), lambda x: x["at"])
    rows = rows.select(F.col("doc_id").alias("id"), F.sort_array(lines).alias("lines"), "all")
    cuts = F.filter("all", lambda x: (x["part"] >= 0) & ~F.array_contains("lines", x["at"]))
    return rows.select("id", "lines", F.transform(F.sort_array(cuts), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["part"].cast("string"))).alias("cuts"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: doc_id, n_lines (with a token), n_dropped, dropped (line numbers from 0, ascending), n_cut, cut (line:sentence, sorted as text)."""
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(NO_WORD)))
    out = docs.select("doc_id", n_lines.alias("n_lines")).join(_to_drop(docs, min_docs).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    lines, cuts = F.coalesce("lines", F.array().cast("array<int>")), F.sort_array(F.coalesce("cuts", F.array().cast("array<string>")))
    return out.select("doc_id", "n_lines", F.size(lines).alias("n_dropped"), lines.alias("dropped"), F.size(cuts).alias("n_cut"), cuts.alias("cut"))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without the recurring lines and sentences; documents that have no other line with a token go. n_chars follows the text."""

    def kept(line, at):
        at_text = at.cast("string")
        rest = F.array_join(F.filter(sentences(line), lambda s, k: ~F.array_contains("cuts", F.concat(at_text, F.lit(":"), k.cast("string")))), "")
        cut = F.exists("cuts", lambda c: F.startswith(c, F.concat(at_text, F.lit(":"))))
        return F.when(~F.array_contains("lines", at), F.when(cut, F.nullif(rest, F.lit(""))).otherwise(line))

    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row")).join(_to_drop(docs, min_docs), "id", "left")
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(F.split("row.text", "\n"), kept), "\n"))
    out = rows.select("row", "lines", text.alias("text")).where(F.col("lines").isNull() | F.col("text").rlike(NO_WORD))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("lines").isNull(), F.col("row").getField("n_chars") if "n_chars" in docs.columns else F.lit(0)).otherwise(F.length("text").cast("long"))}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


ORACLE = rf"""
with lines as (
  select doc_id, cast(idx as integer) as idx, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as raw
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as idx from documents where text is not null)),
inside as (select doc_id, idx, unnest(s) as line, unnest(range(len(s))) as part from (select doc_id, idx, regexp_extract_all(line, '{SENTENCE}') as s from lines where len(raw) > {LONG_LINE})),
units as (select doc_id, idx, -1 as part, raw from lines where len(raw) >= {LEAST_TOKENS}
  union all select * from (select doc_id, idx, cast(part as integer) as part, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as raw from inside) where len(raw) >= {LEAST_SENTENCE}),
tok as (select doc_id, idx, part, case when len(list_filter(raw, lambda x: regexp_matches(x, '[0-9@]'))) * 2 <= len(raw)
    then list_transform(raw, lambda x: case when regexp_matches(x, '[0-9@]') then '<*>' else x end) else raw end as t from units),
form as (select doc_id, idx, part, t, len(t) as n, t[1:{DEPTH}] as head, array_to_string(t, ' ') as masked from tok),
f as (select n, head, t, masked, count(distinct doc_id) as docs, min({{'d': doc_id, 'a': idx, 'p': part}}) as born, n * {100 - SIMILAR} // 100 + 1 as parts from form where n >= {SHORTEST} group by all),
r as (select *, {{'docs': docs, 'd': -born.d, 'a': -born.a, 'p': -born.p, 'm': masked}} as rank from f),
seg as (select n, head, t, masked, rank, i, t[{DEPTH} + i * (n - {DEPTH}) // parts + 1 : {DEPTH} + (i + 1) * (n - {DEPTH}) // parts] as s from (select *, unnest(range(parts)) as i from r)),
tops as (select n, head, i, s, max(rank) as top from seg group by all having count(*) > 1),
pairs as (select distinct seg.n, seg.head, seg.t, seg.masked, top from seg join tops using (n, head, i, s) where top.m <> seg.masked),
alike as (select * from pairs where len(list_filter(list_zip(t, string_split(top.m, ' ')), lambda z: z[1] = z[2])) * 100 >= n * {SIMILAR}),
member as (select n, head, masked, max(top) as top from alike a where not exists (select 1 from alike b where b.n = a.n and b.head = a.head and b.masked = a.top.m) group by all),
mapped as (select form.doc_id, form.idx, form.part, form.n, form.head, coalesce(member.top.m, form.masked) as template from form left join member using (n, head, masked)),
counts as (select n, head, template, min(doc_id) as first from mapped group by all having count(distinct doc_id) >= {MIN_DOCS}),
gone as (select distinct doc_id, idx, part from mapped join counts using (n, head, template) where doc_id > first),
dropped as (select doc_id, list_sort(list(idx)) as dropped from gone where part < 0 group by doc_id),
cut as (select doc_id, list_sort(list(cast(idx as varchar) || ':' || cast(part as varchar))) as cut from gone g where part >= 0 and not exists (select 1 from gone h where h.part < 0 and h.doc_id = g.doc_id and h.idx = g.idx) group by doc_id)
select d.doc_id, cast(coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0) as integer) as n_lines,
  cast(coalesce(len(dropped), 0) as integer) as n_dropped, coalesce(dropped, []) as dropped, cast(coalesce(len(cut), 0) as integer) as n_cut, coalesce(cut, []) as cut
from documents d left join dropped using (doc_id) left join cut using (doc_id)
"""
