"""Byte-level BPE by a rank file, with Spark's higher-order functions doing the merges.

encode_words folds the ranked merges of one word: its bytes, one character each, are an array; an aggregate
over the array joins the leftmost pair of least rank until no pair has a rank. Ranks are an array of
small maps, chosen by the checksum of a pair, since a look-up in a Spark map walks along its keys. Tables of words get
them as scalar subqueries: a literal would stand in every text of a plan that the driver keeps and logs.

Whole documents hold few distinct words, so each distinct word of all documents is folded once:
1. every partition of the documents gives its distinct words; partitions are dealt to a bounded number of blocks;
2. words are brought together, with the numbers of the blocks that have them, and folded;
3. the encoded words go back to their blocks, as a table of the shared folder with a folder for each;
4. every partition is read again and its texts are put together from its own words. No text is shuffled, nothing is
   broadcast but the vocabulary, and a task holds the distinct words of its own input. Should a partition
   hold other rows the second time, the words that it lacks are looked up in the whole table.
Decoding concatenates the binary pieces of the ids, in Spark for each distinct word; a text's bytes are its words' bytes.

Defined cases: a null text counts as empty (no ids; the digests of empty strings); rows with the same id are
encoded each for itself; an empty table gives no rows; other columns are ignored. The pattern's matches are
found by the regex library as in the public rank-file encoders. doc_id is an integer (long).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import work_path
from annalist.llm.pieces import Kept, cut, matcher, slices

#: Up to so many bytes a word's pairs are joined one by one; of longer words, all places of a pair together where that gives the same.
SHORT = 64
PARTS = 4
#: Partitions of the documents share so many folders of encoded words at most, and pieces are concatenated by so many.
BLOCKS, CONCAT = 4_096, 256
_BUCKETS = 1 << 14
_NONE = 2**31 - 1
RANKS, PIECES = "array<map<string,int>>", "array<binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _rank_maps(ranks: dict[bytes, int]) -> str:
    """JSON of RANKS: a byte is the character of the same number, a token lies at the checksum of its string."""
    maps: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        maps[zlib.crc32(key.encode()) % _BUCKETS][key] = rank
    return json.dumps(maps)


def _piece_list(ranks: dict[bytes, int]) -> str:
    """JSON of PIECES: the bytes of each id."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return json.dumps([base64.b64encode(x).decode() for x in pieces])


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """RANKS as a literal, for plans that nobody keeps."""
    return F.from_json(F.lit(_rank_maps(ranks)), RANKS)


def _looked_up(spark: SparkSession, data: str, kind: str) -> Column:
    """JSON data as a scalar subquery of the type; the data are a row of a table, not part of the plan."""
    return spark.createDataFrame([(data,)], "data string").select(F.from_json("data", kind)).scalar()


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_words(word: Column, ranks: Column) -> Column:
    """array<int>: ids of one word; a null or empty word has none."""
    return _let(ranks, lambda r: _encoded(word, r))


def _encoded(word: Column, ranks: Column) -> Column:
    def rank(piece):
        return _let(piece, lambda x: F.coalesce(F.try_element_at(F.try_element_at(ranks, (F.crc32(x) % _BUCKETS).cast("int") + 1), x), F.lit(_NONE)))

    def pair_ranks(p):
        return F.when(F.size(p) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1)))))

    def merge_one(s, _):
        def at(i):
            return _let(F.concat(F.element_at(s["p"], i), F.element_at(s["p"], i + 1)), lambda new: joined(i, new))

        def joined(i, new):
            p, r = s["p"], s["r"]
            none = F.array().cast("array<int>")
            left = F.when(i > 1, F.array(rank(F.concat(F.element_at(p, i - 1), new)))).otherwise(none)
            right = F.when(i < F.size(r), F.array(rank(F.concat(new, F.element_at(p, i + 2))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(p))).alias("r"),
            )

        least = F.array_min(s["r"])
        return F.when(F.coalesce(least, F.lit(_NONE)) == _NONE, s).otherwise(_let(F.array_position(s["r"], least).cast("int"), at))

    def merge_all(s, k):
        """Joins all places of the least pair at once if no pair that this makes, or that joining one place after another
        would make, ranks lower; then the order doesn't matter. Else the first place only."""
        p, r, least = s["p"], s["r"], F.array_min(s["r"])
        # M: joins the next piece; S: is joined to the piece before
        marks = F.regexp_replace(F.concat(F.array_join(F.transform(r, lambda x: F.when(x == least, "1").otherwise("0")), ""), F.lit("0")), "1.", "MS")

        def joined(m):
            q = F.filter(F.transform(p, lambda x, i: F.when(F.element_at(m, i + 1) == "M", F.concat(x, F.element_at(p, i + 2))).when(F.element_at(m, i + 1) != "S", x)), lambda x: x.isNotNull())
            between = F.transform(F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: (F.element_at(m, i) == "M") & (i < F.size(r))), lambda i: rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1), F.element_at(p, i + 2))))
            return _let(q, lambda x: _let(pair_ranks(x), lambda y: F.when(F.coalesce(F.array_min(F.concat(y, between)), F.lit(_NONE)) >= least, F.struct(x.alias("p"), y.alias("r"))).otherwise(merge_one(s, k))))

        return F.when(F.coalesce(least, F.lit(_NONE)) == _NONE, s).otherwise(_let(F.split(marks, ""), joined))

    def fold(p):
        start = F.struct(p.alias("p"), pair_ranks(p).alias("r"))
        steps = F.slice(p, 2, F.size(p))
        pieces = F.when(F.size(p) <= SHORT, F.aggregate(steps, start, merge_one, lambda s: s["p"])).otherwise(F.aggregate(steps, start, merge_all, lambda s: s["p"]))
        return F.transform(pieces, rank)

    as_bytes = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return F.when(F.length(word) > 0, _let(as_bytes, fold)).otherwise(F.array().cast("array<int>"))


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """block (number of the partition), word: the distinct words of each partition."""

    def run(batches):
        words_of, first, rest, told, known = matcher(pattern), set(), set(), set(), set()
        block = TaskContext.get().partitionId() % BLOCKS

        def new():
            words, other = {w for x in first for w in words_of(x)}, []
            for x in rest:
                if x in known:
                    continue
                if x.isalpha():
                    words.add(" " + x)
                else:
                    other.append(x)
            for x in other:
                words.update(words_of(" " + x))
            if len(known) < 400_000:
                known.update(other)
            first.clear()
            rest.clear()
            out = list(words - told)
            if len(told) < 1_000_000:
                told.update(out)
            return pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int32()), pa.array(out, pa.string())], ["block", "word"])

        for batch in batches:
            for cell in batch.column(0):
                pieces = cut(cell.as_py() or "")
                first.add(pieces[0])
                rest.update(pieces[1:])
                if len(rest) + len(first) > 200_000:
                    yield new()
        yield new()

    return docs.select("text").mapInArrow(run, "block int, word string")


def decode_words(ids: Column, ranks: dict[bytes, int] | Column) -> Column:
    """binary: the pieces of the ids, concatenated one after another, a long word's by CONCAT and then those. ranks: also a column of PIECES."""
    table = ranks if isinstance(ranks, Column) else F.from_json(F.lit(_piece_list(ranks)), PIECES)

    def joined(parts):
        return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))

    def whole(parts):
        some = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(CONCAT)), lambda k: joined(F.slice(parts, k + 1, CONCAT)))
        return F.when(F.size(parts) <= CONCAT, joined(parts)).otherwise(joined(some))

    return F.element_at(F.transform(F.array(F.transform(ids, lambda i: F.element_at(table, i + 1))), whole), 1)


def folded(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """words (a column word, and others) with ids, a line of numbers, and bytes, what they decode to, null where that is the word.

    Spark allows no subquery inside higher-order functions, but a column of it, which the optimizer puts in its place where it
    is used once. `pieces` is added where `numbers` is used twice, so that this step isn't merged with the fold before it, but with the
    one after it: else each row would carry a copy of the vocabulary.
    """
    spark, kept = words.sparkSession, words.columns
    numbers = words.select(*kept, _looked_up(spark, _rank_maps(ranks), RANKS).alias("ranks")).select(*kept, encode_words(F.col("word"), F.col("ranks")).alias("numbers"))
    told = numbers.select(*kept, "numbers", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("ids"), _looked_up(spark, _piece_list(ranks), PIECES).alias("pieces"))
    return told.select(*kept, "ids", F.nullif(decode_words(F.col("numbers"), F.col("pieces")), F.encode("word", "UTF-8")).alias("bytes"))


def write_words(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> str:
    """Encodes each distinct word once and decodes its ids; returns the folder of the table (word, ids as a line of numbers,
    bytes: what the ids decode to, null where that is the word itself, which then isn't stored twice) by block."""
    spark, path = docs.sparkSession, work_path(docs.sparkSession, "bpe-words")
    words = distinct_words(docs, pattern).groupBy("word").agg(F.collect_set("block").alias("blocks"))
    told = folded(words, ranks)  # once a word, before its blocks are told apart
    decoded = told.select(F.explode("blocks").alias("block"), "word", "ids", "bytes")
    # A number of partitions that is given, else adaptive execution merges them; a block's words come from PARTS tasks.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    decoded.repartition(n, "block", F.pmod(F.hash("word"), F.lit(PARTS))).write.partitionBy("block").parquet(path)
    return path


class BlockWords:
    """The encoded words of one partition; others are looked up in the whole table."""

    def __init__(self, path: str, block: int):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        self.ids: dict[str, bytes] = {}
        self.bytes: dict[str, bytes] = {}
        self._read(f"{self.base}/block={block}")

    def _read(self, place: str, words=None) -> None:
        import pyarrow.dataset as ds

        if self.system.get_file_info(place).type.name != "Directory":
            return
        data = ds.dataset(place, filesystem=self.system, format="parquet", schema=pa.schema([("word", pa.string()), ("ids", pa.string()), ("bytes", pa.binary())]))
        table = data.to_table(filter=None if words is None else ds.field("word").isin(words))
        found = table.column("word").to_pylist()
        self.ids.update(zip(found, table.column("ids").cast(pa.binary()).to_pylist(), strict=True))
        other = table.filter(ds.field("bytes").is_valid())
        self.bytes.update(zip(other.column("word").to_pylist(), other.column("bytes").to_pylist(), strict=True))

    def decoded(self, word: str) -> bytes:
        """What Spark decoded from the word's ids."""
        return self.bytes[word] if word in self.bytes else word.encode()

    def lack(self, words: list[str]) -> None:
        """Fetches words that the partition didn't have."""
        if missing := [w for w in words if w not in self.ids]:
            self._read(self.base, missing)


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves if keep_ids)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranks = read_ranks(rank_path)
    path = write_words(docs, pattern, ranks)

    def whole(batches):
        words_of, table, odd = matcher(pattern), None, {}

        def both(text: str) -> tuple[bytes, bytes | None]:
            """A piece's ids and the bytes that they decode to; none if those are the piece."""
            if (ids := table.ids.get(text)) is not None:  # the whole piece is one word
                return ids, table.bytes.get(text)
            words = words_of(text)
            table.lack(words)
            data = b"".join(map(table.decoded, words))
            return b",".join(map(table.ids.__getitem__, words)), None if data == text.encode() else data

        def new(piece: str) -> bytes:
            ids, data = both(" " + piece)
            if data is not None:
                odd[piece] = data
            return ids

        numbers = Kept(300_000, new)
        for batch in batches:
            table = table or BlockWords(path, TaskContext.get().partitionId() % BLOCKS)
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices([len(x or "") for x in texts]):
                numbers.trim()
                if len(odd) > 100_000:
                    for known in (odd, numbers, numbers.old):
                        known.clear()
                out = []
                for text in texts[i:j]:
                    first, *others = cut(text or "")
                    ids, data = both(first) if first else (b"", None)
                    ids = b",".join([ids, *map(numbers.__getitem__, others)] if ids else map(numbers.__getitem__, others))
                    if data is None and not (odd and any(x in odd for x in others)):  # every piece decodes to itself
                        data = (text or "").encode()
                    else:
                        data = b"".join([first.encode() if data is None else data, *(odd[x] if x in odd else (" " + x).encode() for x in others)])
                    out.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest(), ids if keep_ids else None))
                columns = [doc_ids.slice(i, j - i), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([[int(n) for n in x[3].split(b",")] if x[3] else [] for x in out], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.mapInArrow(whole, schema).withColumnRenamed("doc_id", id_col)
