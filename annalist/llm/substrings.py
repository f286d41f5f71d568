r"""Passages that an earlier document has, by suffix trees over word prefixes.

A passage is LEAST consecutive words; a suffix is a document's words from some place on, of which the first LEAST matter.

1. Documents of the same words are one class; only its first goes on, the others lose all their passages.
2. A suffix below no deep node isn't worth sending. The least of the SAMPLE-word hashes in a passage is the same wherever
   the passage stands; one pass sends these anchors, each document's once and sorted into blobs, and those of several
   documents come back. Suffixes without such an anchor are leaves of no repeat.
3. Of the other suffixes a path is kept: hashes of their first 2, 5, 9 and LEAST words, so edges of the tree are compressed.
   They are split by prefixes of variable length: by their first 2 words, and where more than GROUP suffixes share these, by
   5, 9 or all words. Equal suffixes of a task are sent once, with their least doc_id.
4. Each group is a subtree that fits into memory: sorted paths and what they have in common with the one before give its
   nodes. Those of depth LEAST are repeats; their least doc_id is the first, and all other documents below them are told.
5. A document's words that repeats of an earlier one cover are removed.

Passages are compared by a 64-bit hash and three 32-bit hashes of their beginnings. Rows of a common anchor or passage meet in
their tasks first; documents of a large class stay where they are. Memory holds a blob of PART entries, a group, and one text.

Defined cases: a null or empty text has no words; passages that a document repeats itself don't count; rows with the same
doc_id are rows of one document; a null doc_id comes before and after no other, so it loses nothing and takes nothing;
repeated rows are each returned; an empty table gives no rows; other columns are ignored. doc_id is an integer (long).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import FEW, with_key_row, written

LEAST = 13
SAMPLE = 6
PREFIXES = (2, 5, 9, LEAST)
#: Suffixes of a subtree, entries that a task gathers, and bytes of text that it works on at once.
GROUP, PART, CHUNK = 1 << 19, 1 << 18, 1 << 20
_random = np.random.default_rng(12)
_LETTER = _random.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Stands for the document of an anchor that its task knows to be shared.
_NONE = np.iinfo(np.int64).min
_EMPTY = hashlib.sha256(b"").hexdigest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of several texts that stand one after another in memory."""

    def __init__(self):
        self.powers, self.backs = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            many = np.full(max(n, CHUNK), _BASE)
            many[0] = 1
            back = np.full(len(many), _BACK)
            back[0] = 1
            self.powers, self.backs = np.multiply.accumulate(many), np.multiply.accumulate(back)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of the text) of each word; text k is data[bounds[k]:bounds[k + 1]]."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._reach(len(data) + 1)
        solid = ~_BLANK[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        cuts = bounds[:-1][bounds[:-1] < len(data)]
        begins[cuts] = solid[cuts]
        first = np.flatnonzero(begins)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        tails = bounds[1:][bounds[1:] > 0] - 1
        last[tails] = solid[tails]
        after = np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * self.powers[: len(data)], out=sums[1:])
        words = _mixed((sums[after] - sums[first]) * self.backs[first] + (after - first).astype(np.uint64))
        return words, np.searchsorted(bounds, first, side="right") - 1


def _chained(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = _mixed(out * _BASE + words[k : k + len(out)])
    return out


def _chunks(batches, text: int):
    """(batch, first row, row after the last, data, bounds) of about CHUNK bytes of the texts in a column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            yield batch, at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def _anchors(words: np.ndarray) -> np.ndarray:
    """The least SAMPLE-word hash of each LEAST consecutive words."""
    least, reach, width = _chained(words, SAMPLE), 1, LEAST - SAMPLE + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def _passages(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where passages begin: LEAST words on, it is still the same text."""
    return np.flatnonzero(text[: len(text) - LEAST + 1] == text[LEAST - 1 :]) if len(text) >= LEAST else np.zeros(0, np.int64)


def _pairs(docs: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes.view(np.int64))], ["doc_id", "hash"])


def texts_told(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_words, digest of the words, sha256 of the words joined by a space."""

    def run(batches):
        import xxhash

        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                joined = b" ".join(words)
                rows.append((len(words), xxhash.xxh3_128_digest(joined), hashlib.sha256(joined).hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "key", "n_words", "digest", "sha"])

    return docs.mapInArrow(run, "doc_id long, key long, n_words long, digest binary, sha string")


def shared_anchors(docs: DataFrame, slots: int) -> DataFrame:
    """doc_id, hash: the anchors of each text that other documents have too."""

    def send(batches):
        words, kept, n = Words(), [], 0

        def blobs():
            hashes, ids = (np.concatenate([x[k] for x in kept]) for k in (0, 1))
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])])
            hashes, ids = hashes[new], ids[new]
            head = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            alone = head & np.concatenate([head[1:], [True]])
            # What several documents of this task share is known here; others learn it from one entry without a document.
            known = ~alone
            sent, owner = hashes[head], np.where(alone, ids, _NONE)[head]
            slot = (sent % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            sent, owner, slot = sent[order], owner[order], slot[order]
            cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])), [len(slot)]])
            rows = [(int(slot[a]), sent[a:b].tobytes(), owner[a:b].tobytes(), False) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            hashes, ids = hashes[known], ids[known]
            rows += [(int(hashes[k] % np.uint64(slots)), hashes[k : k + 4096].tobytes(), ids[k : k + 4096].tobytes(), True) for k in range(0, len(hashes), 4096)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["slot", "hashes", "docs", "known"])

        for batch, at, end, data, bounds in _chunks(batches, 1):
            h, text = words(data, bounds)
            starts = _passages(h, text)
            if len(starts):
                anchors, text = _anchors(h)[starts], text[starts]
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])])
                ids = batch.column(0).slice(at, end - at).to_numpy(zero_copy_only=False)
                kept.append((anchors[new], ids[text[new]].astype(np.int64)))
                n += len(kept[-1][0])
            if n >= 2 * PART:
                yield blobs()
                kept, n = [], 0
        if kept:
            yield blobs()

    def back(batches):
        for _, rows in _by_slot(batches, ("slot",)):
            known = [r for r in rows if r["known"]]
            for r in known:
                yield _pairs(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["hashes"], np.uint64))
            if len(rows) > len(known):
                hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows if not r["known"]])
                ids = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows if not r["known"]])
                order = np.argsort(hashes, kind="stable")
                hashes, ids = hashes[order], ids[order]
                same = hashes[1:] == hashes[:-1]
                shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                told = shared & (ids != _NONE)
                yield _pairs(ids[told], hashes[told])

    blobs = docs.mapInArrow(send, "slot long, hashes binary, docs binary, known boolean")
    return blobs.repartition("slot").sortWithinPartitions("slot").mapInArrow(back, "doc_id long, hash long")


def _by_slot(batches, keys):
    """(key, rows) of rows that come sorted by their key."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(r)
    if rows:
        yield now, rows


def _paths(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first words by all PREFIXES but the last (a column each), and of all LEAST words, of suffixes at starts."""
    out, columns = np.zeros(len(starts), np.uint64), []
    for k in range(LEAST):
        if k in PREFIXES:
            columns.append((out >> np.uint64(32)).astype(np.uint32))
        out = _mixed(out * _BASE + words[starts + k])
    return np.column_stack(columns), out


_SUFFIXES = "prefix int, slot long, n long, marks binary, passages binary, docs binary"
_NAMES = [c.split()[0] for c in _SUFFIXES.split(", ")]
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _split(marks: np.ndarray, passages: np.ndarray, docs: np.ndarray, level: int, slots: int) -> list[tuple]:
    """A row of _SUFFIXES for each slot of these suffixes, by their first PREFIXES[level] words."""
    first = passages if PREFIXES[level] == LEAST else _mixed(marks[:, level].astype(np.uint64))
    slot = (first % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    marks, passages, docs, slot = marks[order], passages[order], docs[order], slot[order]
    cuts = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])), len(slot))
    return [(PREFIXES[level], int(slot[a]), int(b - a), marks[a:b].tobytes(), passages[a:b].tobytes(), docs[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _joined(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = len(PREFIXES) - 1
    parts = [(np.frombuffer(r["marks"], np.uint32).reshape(-1, width), np.frombuffer(r["passages"], np.uint64), np.frombuffer(r["docs"], np.int64)) for r in rows]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def suffixes(docs: DataFrame, slots: int) -> DataFrame:
    """Suffixes at shared anchors (doc_id, text, anchors) in rows of a slot; those of prefix 0 are repeats that a task has found itself."""

    def run(batches):
        hasher, kept, n = Words(), [], 0

        def rows():
            marks, passages, ids = (np.concatenate([x[k] for x in kept]) for k in (0, 1, 2))
            order = np.lexsort((ids, passages))
            passages, ids = passages[order], ids[order]
            head = np.append(True, passages[1:] != passages[:-1])
            first = ids[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.append(True, (passages[1:] != passages[:-1]) | (ids[1:] != ids[:-1])) & (ids > first)
            told = _split(marks[order][head], passages[head], ids[head], 0, slots)
            own, of = passages[later], ids[later]
            told += [(0, int(own[k] % np.uint64(slots)), len(own[k : k + 4096]), b"", own[k : k + 4096].tobytes(), of[k : k + 4096].tobytes()) for k in range(0, len(own), 4096)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in told], t) for k, t in enumerate(_KINDS)], _NAMES)

        for batch, at, end, data, bounds in _chunks(batches, 1):
            h, text = hasher(data, bounds)
            starts = _passages(h, text)
            if len(starts):
                lists = batch.column(2).slice(at, end - at)
                of = np.repeat(np.arange(end - at), np.diff(np.asarray(lists.offsets)))
                wanted = _mixed(lists.flatten().to_numpy().view(np.uint64) + _BASE * of.astype(np.uint64))
                starts = starts[np.isin(_mixed(_anchors(h)[starts] + _BASE * text[starts].astype(np.uint64)), wanted)]
            if len(starts):
                ids = batch.column(0).slice(at, end - at).to_numpy(zero_copy_only=False)
                kept.append((*_paths(h, starts), ids[text[starts]].astype(np.int64)))
                n += len(starts)
            if n >= PART:
                yield rows()
                kept, n = [], 0
        if kept:
            yield rows()

    return docs.select("doc_id", "text", "anchors").mapInArrow(run, _SUFFIXES)


def deep_nodes(marks: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): suffixes in the tree's order, and where in it each node of depth LEAST begins (leaves among them)."""
    order = np.lexsort((passages, *marks.T[::-1]))
    paths = np.column_stack([marks.astype(np.uint64), passages])[order]
    same = paths[1:] == paths[:-1]
    common = np.where(same.all(axis=1), len(PREFIXES), same.argmin(axis=1))  # edges from the root shared with the suffix before
    return order, np.flatnonzero(np.append(True, common < len(PREFIXES)))


def _subtrees(rows: DataFrame, level: int, slots: int, group: int) -> DataFrame:
    """doc_id, hash: repeats by the subtree of each slot; or rows of _SUFFIXES of slots of over `group`, split by the next prefix."""
    last = level + 1 == len(PREFIXES)

    def found(docs, hashes):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes.view(np.int64)), *(pa.nulls(len(docs), t) for t in _KINDS)], ["doc_id", "hash", *_NAMES])

    def longer(rows):
        told = _split(*_joined(rows), level + 1, slots)
        return pa.RecordBatch.from_arrays([pa.nulls(len(told), pa.int64())] * 2 + [pa.array([r[k] for r in told], t) for k, t in enumerate(_KINDS)], ["doc_id", "hash", *_NAMES])

    def repeats(rows):
        marks, passages, docs = _joined(rows)
        order, starts = deep_nodes(marks, passages)
        passages, docs = passages[order], docs[order]
        later = docs > np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(docs))))
        return found(docs[later], passages[later])

    def run(batches):
        slot, kept, n = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["prefix"] == 0:
                    yield found(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["passages"], np.uint64))
                    continue
                if r["slot"] != slot:
                    if kept:
                        yield repeats(kept) if last or n <= group else longer(kept)
                    slot, kept, n = r["slot"], [], 0
                kept.append(r)
                n += r["n"]
                if n > group and not last:  # n stays above: what follows of this slot is split as it comes
                    yield longer(kept)
                    kept = []
        if kept:
            yield repeats(kept) if last or n <= group else longer(kept)

    return rows.select(*_NAMES).repartition("slot").sortWithinPartitions("slot").mapInArrow(run, f"doc_id long, hash long, {_SUFFIXES}")


def repeats(rows: DataFrame, slots: int, group: int) -> DataFrame:
    """doc_id, hash: passages that a document with a smaller id has too."""
    out = None
    for level in range(len(PREFIXES)):
        told = written(_subtrees(rows, level, slots, group), "subtrees")
        own = told.where("doc_id is not null").select("doc_id", "hash")
        out = own if out is None else out.unionByName(own)
        rows = told.where("prefix is not null")
        if rows.isEmpty():
            break
    return out


def _with_texts(docs: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """docs of which there are hashes (doc_id, hash), with the array of them; other documents' texts don't move."""
    lists = written(hashes.groupBy("doc_id").agg(F.collect_list("hash").alias(name)), f"substring-{name}")
    ids = lists.select("doc_id").distinct()
    if ids.count() <= FEW:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(lists, "doc_id")


def _without(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_removed, sha of the kept words, spans of (start, length) in words, for docs (doc_id, key, text, gone)."""

    def run(batches):
        hasher = Words()
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                h, _ = hasher(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                gone = batch.column(3)[k].values.to_numpy().view(np.uint64)
                change = np.zeros(len(h) + 1, np.int64)
                at = np.flatnonzero(np.isin(_chained(h, LEAST), gone))
                np.add.at(change, at, 1)
                np.add.at(change, at + LEAST, -1)
                covered = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                kept = b" ".join(w for w, c in zip(data.split(), covered.tolist(), strict=True) if not c)
                out.append((int(covered.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "key", "n_removed", "sha", "spans"])

    return docs.select("doc_id", "key", "text", "gone").mapInArrow(run, "doc_id long, key long, n_removed long, sha string, spans array<struct<start: long, length: long>>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256, spans (start and length in words of what is removed)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    told = written(texts_told(docs), "substring-texts")
    long = told.where((F.col("n_words") >= LEAST) & F.col("doc_id").isNotNull())
    size = long.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    slots = max(4_096, size.words // (4 * GROUP))
    classes = long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1")
    copies = with_key_row(long, classes, "digest", "size", size.n, few=FEW).where("doc_id > first").select("doc_id", "key").distinct()
    copies = written(copies, "substring-copies")
    one_of_each = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * LEAST - 1))
    one_of_each = one_of_each.join(F.broadcast(copies) if copies.count() <= FEW else copies, ["doc_id", "key"], "left_anti")

    anchored = _with_texts(one_of_each, shared_anchors(one_of_each.select("doc_id", "text"), slots), "anchors")
    gone = repeats(suffixes(anchored, slots), slots, group)
    cut = written(_without(_with_texts(one_of_each, gone, "gone")).dropDuplicates(["doc_id", "key"]), "substring-cuts")

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))
    marked = copies.withColumn("copy", F.lit(True))
    out = told.join(cut.withColumnRenamed("sha", "cut_sha").unionByName(marked, allowMissingColumns=True), ["doc_id", "key"], "left")
    nothing = F.array().cast("array<struct<start: bigint, length: bigint>>")
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), _EMPTY).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"), F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )


ORACLE = r"""
with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
passage as (select doc_id, s, array_to_string(w[s:s + 12], ' ') as p from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from words where len(w) >= 13)),
first as (select p, min(doc_id) as d from passage group by p),
gone as (select distinct doc_id, s + unnest(range(13)) as k from passage join first using (p) where d < doc_id),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from words),
kept as (select e.doc_id, string_agg(word, ' ' order by e.k) as text from each e left join gone g on g.doc_id = e.doc_id and g.k = e.k where g.k is null group by e.doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from words w left join lost using (doc_id) left join kept on kept.doc_id = w.doc_id
"""
