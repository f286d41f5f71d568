"""Token ids in ORC files: written in document order, read back stripe by stripe.

Writing: a range exchange by doc_id and a sort inside partitions give files in ascending order of ids; every row
carries its number in that order; the texts are encoded in Arrow batches by the tokenizers library, each distinct piece of text once per worker
while it stays in a bounded cache. ORC keeps integers in run-length encoding, a row index every few thousand
rows, and a Bloom filter on doc_id, so that readers split files at stripes and skip row groups by metadata.

Reading: per document the count and checksum of the ids come from the files; the ids before a document are
the totals of earlier files (one row a file) plus a running sum inside its file, in the order of the rows' numbers.

Defined cases: a null or empty text holds the end id only; text that spells an added token of the tokenizer is that
token, as in the library; rows with the same doc_id are in the order of docs; a null doc_id comes first; an
empty table gives no rows; other columns are ignored. doc_id is an integer (long).
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import work_path, written
from annalist.llm.pieces import MARKS, Kept, cut, matcher, slices

ROW_INDEX_STRIDE = 2_000
STRIPE_BYTES = 16 << 20
_BLANK = re.compile(r"\s").search
SCHEMA = "doc_id long, row long, ids array<int>"


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers; most: pieces kept in the cache.

    A piece's matches are given to the library's model one by one, each in the alphabet that stands for bytes; the
    library's whole encoder would do the same work for them at several times the cost. Texts that hold one of the
    tokenizer's added tokens go to the library whole, as it takes those out of a text first; so do all texts where
    the file asks for anything but plain byte-level BPE.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.model, self.words = tokenizer, tokenizer.model, matcher()
        self.added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.plain = byte_level(json.loads(tokenizer.to_str()))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.shown = {"": "", " ": self.alphabet[32]}
        self.rest, self.first, self.marks = Kept(most, partial(self._new, " ")), Kept(most // 4, partial(self._new, "")), {}

    def _shown(self, match: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(match)]).tobytes()

    def _ids(self, match: str) -> bytes:
        return self._shown(match.encode().decode("latin-1").translate(self.alphabet))

    def _mark(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) > 20_000:
                self.marks.clear()
            self.marks[marks] = found = self._ids(marks)
        return found

    def _new(self, prefix: str, piece: str) -> bytes:
        """Most pieces are letters, or letters and marks after them; lines inside a piece are pieces of their own."""
        if piece.isalpha():
            return self._shown(self.shown[prefix] + piece) if piece.isascii() else self._ids(prefix + piece)
        kept, word = self.rest if prefix else self.first, piece.rstrip(MARKS)
        if word.isalpha():
            return kept[word] + self._mark(piece[len(word) :])
        lines = piece.split("\n")
        if len(lines) > 1 and all(lines) and not any(map(_BLANK, lines)):
            return self._mark("\n").join([kept[lines[0]], *(self.first[x] for x in lines[1:])])
        return b"".join(map(self._ids, self.words(prefix + piece)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i: self._whole(x) for i, x in enumerate(texts) if not self.plain or any(a in x for a in self.added)}
        found = iter(self._pieces([x for i, x in enumerate(texts) if i not in whole] if whole else texts))
        return [whole[i] if i in whole else next(found) for i in range(len(texts))]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        self.first.trim()
        self.rest.trim()
        first, rest, out = self.first, self.rest.__getitem__, []
        for x in texts:
            head, *others = cut(x)
            out.append(first[head] + b"".join(map(rest, others)))
        return out


def byte_level(file: dict) -> bool:
    """Whether a tokenizer's file asks for byte-level BPE and nothing else: pieces may then be encoded one by one."""
    before, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(plain and model.get("type") == "BPE" and not any(model.get(k) for k in odd) and not any(file.get(k) for k in ("normalizer", "truncation", "padding")))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row and ids (array<int>), each with end_id after it; row by row, in the order of docs.

    row: the column row_col, or the number of the row in its partition's range of numbers.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1), [x or "" for x in batch.column(2).to_pylist()]
            for i, j in slices([len(x) for x in texts], 4 << 20):
                found = [x + end for x in own.encode(texts[i:j])]
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(found))])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), rows.slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "row", "ids"])

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    return docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Ranges are cut by doc_id and the row's place in docs, so that many rows of one id are shared out."""
    order = ["doc_id", "nth"]
    ranged = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("nth"), F.col(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encode_documents(ranged, tokenizer_path, end_id)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row (its order) and ids; a filter on doc_id skips files, stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, row."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "row", "n_tokens", "ids_crc32"])

    read = read_token_files(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "row", "ids")
    rows = written(read.mapInArrow(run, "file string, doc_id long, row long, n_tokens long, ids_crc32 long"), "token-digests")
    files = rows.groupBy("file").agg(F.min("row").alias("least"), F.sum("n_tokens").alias("tokens"))  # a row a file
    files = files.select("file", F.coalesce(F.sum("tokens").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("upto", F.sum("n_tokens").over(inside))
        .join(F.broadcast(files), "file")
        .select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "ids_crc32", "row")
    )


def tokenise_to_orc(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes the files below the shared folder and returns their digests."""
    path = work_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_digests(docs.sparkSession, path)
