"""From raw documents to token ids: quality, near copies, repeated passages, benchmark passages, sub-words."""

from __future__ import annotations

from loomtrace.llm.decontam import remove_spans
from loomtrace.llm.neardup import keep_one
from loomtrace.llm.pieces import encode
from loomtrace.llm.quality import keep_good
from loomtrace.llm.queries import table, tokenizer
from loomtrace.llm.session import new_folder
from loomtrace.llm.suffix import drop_repeats


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document, the smallest doc_id, of each near-duplicate group: links are a likeness of 0.8 or more on shingles of five words."""
    return keep_one(docs, percent=80, words=5)


def suffix_dedup(spark, docs, sf_dir):
    """Texts without the byte strings of 100 that also start earlier."""
    return drop_repeats(docs)


def decontaminate(spark, docs, sf_dir):
    """Texts without the words of benchmark windows."""
    return remove_spans(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Piece ids of each text, with the documents' other columns but the text."""
    return encode(docs, tokenizer("piece_bpe_32k.model"), keep=tuple(c for c in docs.columns if c != "text"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Models and sub-words have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each stage's result is a table of the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        path = new_folder(spark, f"pipeline-{i}-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
