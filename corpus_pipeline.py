"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs:
- quality_rules: lines that fail a rule go; documents that are rejected go;
- line_dedup: lines and sentences of recurring templates go from all documents but the first; documents left without lines go;
- near_dedup: of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays;
- decontamination: documents that hold a benchmark item, up to a tenth of edits, go;
- byte_bpe: per document the number of tokens and the digests of its ids and of the decoded text.

All stages but the last return the columns of documents. Null and empty texts are rejected by the first stage;
repeated rows, rows without an id and ties are treated as the operators say; empty tables give empty results; further
columns of the input, whatever their names, are left alone, since stages keep a row together and select what they add.
doc_id is an integer (long).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.bpe import encode_and_decode
from annalist.llm.common import work_path
from annalist.llm.decontaminate import without_leaks
from annalist.llm.minhash import near_duplicates
from annalist.llm.quality import quality
from annalist.llm.templates import without_recurring_lines


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality(docs.select(F.struct("*").alias("row"), "text"), clean_col="clean").where("kept")
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("lost_chars") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return judged.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the candidate search's estimates nor the tokens; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
