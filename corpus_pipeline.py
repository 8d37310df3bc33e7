"""Pipeline over the documents table: each stage works on what the stage before kept.

Toxic documents go, one document of each group of near duplicates stays, documents with benchmark items go,
secrets are masked in what is left, and the texts are encoded. Every stage's result is written as Parquet
and read back as the next stage's documents.

Only ``text`` decides, and for the label join ``doc_id``; other columns are passed on, whatever they are called. Null, empty and
wordless texts are kept by every stage (null stays null, its ids are null). Rows with a null id are judged like others; as copies
they go where a row with an id can stay. Of rows that repeat an id and a text one stays, of a group of near copies the one with the smallest
id, so ties need no rule. Texts are read whole, however long. Empty tables give an empty result; without labels no text is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import decontamination, ngram_join, secret_scan, sentencepiece_codec, toxicity
from recollect.llm.common import Scratch, crc_mod, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.accepted(docs, toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, Scratch(spark, "pipeline-ngram-join"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-decontamination"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.model_bytes())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]
#: Training, retrieval and a tokenizer's merges have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives for all documents; it is read from the shared folder, where nothing else of the run is left."""
    scratch = Scratch(spark, "whole-pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with Scratch.collecting() as own:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        for s in own:  # the stage's result is written; other runs' tables are theirs
            s.close()
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
