"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers

from annalist.llm.bpe import encode_and_decode
from annalist.llm.common import documents
from annalist.llm.decontaminate import contaminated
from annalist.llm.dialogues import repaired
from annalist.llm.licenses import scan_licenses
from annalist.llm.minhash import near_duplicates
from annalist.llm.quality import ORACLE as QUALITY_SQL
from annalist.llm.quality import quality_digest
from annalist.llm.sharding import shard_by_bytes
from annalist.llm.substrings import ORACLE as PASSAGES_SQL
from annalist.llm.substrings import repeated_passages
from annalist.llm.templates import ORACLE as TEMPLATES_SQL
from annalist.llm.templates import dropped_lines
from annalist.llm.token_files import tokenise_to_orc
from annalist.llm.toxicity import toxicity
from annalist.llm.warc import ORACLE as WARC_SQL
from annalist.llm.warc import archived
from annalist.llm.whitening import whitened


def op1_quality_rules(spark, sf_dir):
    return quality_digest(documents(spark, sf_dir))


def op2_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=2)


def op3_line_templates(spark, sf_dir):
    return dropped_lines(documents(spark, sf_dir))


def op4_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_token_files(spark, sf_dir):
    return tokenise_to_orc(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("row")


def op6_warc(spark, sf_dir):
    return archived(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_sharding(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir), n_shards=8)


def op9_licenses(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


def op10_byte_bpe(spark, sf_dir):
    return encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark, sf_dir):
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_substrings(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir)).drop("spans")


def op13_dialogues(spark, sf_dir):
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash": op2_minhash,
    "op3_line_templates": op3_line_templates,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_whitening": op11_whitening,
    "op12_substrings": op12_substrings,
    "op13_dialogues": op13_dialogues,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": QUALITY_SQL, "op3_line_templates": TEMPLATES_SQL, "op6_warc": WARC_SQL, "op12_substrings": PASSAGES_SQL}
