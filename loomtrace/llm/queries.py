"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .decontam import ORACLE as DECONTAM_SQL
from .neardup import ORACLE as NEAR_SQL
from .prefixtrie import ORACLE as TRIE_SQL
from .suffix import ORACLE as SUFFIX_SQL
from .warc import ORACLE as WARC_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A file of the public tokenizers; LOOMTRACE_TOKENIZERS names another folder."""
    folder = os.environ.get("LOOMTRACE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import revisit_rows

    return revisit_rows(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), percent=85)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op9_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination_digests

    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, added=True)


def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urltree import judge

    return judge(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_license_scan": op5_license_scan,
    "op6_quality_ranking": op6_quality_ranking,
    "op7_minmax_near_dedup": op7_minmax_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_fm_index_decontamination": op9_fm_index_decontamination,
    "op10_token_files": op10_token_files,
    "op11_url_templates": op11_url_templates,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op4_warc_revisits": WARC_SQL,
    "op7_minmax_near_dedup": NEAR_SQL,
    "op8_suffix_dedup": SUFFIX_SQL,
    "op9_fm_index_decontamination": DECONTAM_SQL,
    "op12_prefix_trie": TRIE_SQL,
}
