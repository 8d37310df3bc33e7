"""Ingestion: normalise, chunk, extract, index without duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import SPACE, non_empty, normalize_text
from ..plugins import extractor

MAX_CHARS, OVERLAP, MAX_CHUNKS = 4000, 400, 200
TRIM = SPACE
#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def soft_break(piece: str) -> int:
    """Where to end a full piece: at its last blank line or else last newline, if that lies past the middle; 0: nowhere."""
    for mark in ("\n\n", "\n"):
        at = piece.rfind(mark)
        if at > len(piece) // 2:
            return at
    return 0


def chunks(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP, most: int | None = MAX_CHUNKS) -> list[str]:
    """Pieces of a normalised text, the first ``most`` (None: all); pieces overlap after a soft break only."""
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    start = 0
    while start < len(text) and (most is None or len(out) < most):
        end = min(start + size, len(text))
        stop = end if end == len(text) else start + soft_break(text[start:end]) or end
        if end < len(text) and stop == start:
            stop = end
        if piece := text[start:stop].strip(TRIM):
            out.append(piece)
        if stop == len(text):
            break
        start = stop if stop == end else max(stop - overlap, start + 1)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches: a Python worker holds a batch's texts, its pieces and copies of both. Lower limits stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


@F.pandas_udf(ArrayType(StringType()))
def _chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: chunks(t) if t else [])


@F.pandas_udf(ArrayType(StringType()))
def _all_chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: chunks(t, most=None) if t else [])


def chunk(df: DataFrame, text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per piece with its place; texts that are empty after normalising give none. ``whole``: texts beyond ``MAX_CHUNKS`` pieces are cut up to their end.

    One pass: each text is normalised once, and only texts beyond one piece go through Python, in batches of bounded size.
    """
    bounded_batches(df.sparkSession)
    norm = F.col("_norm")
    rows = df.select("*", F.explode(F.array(normalize_text(F.col(text_col)))).alias("_norm")).where(non_empty(norm))  # a generated column is not computed anew where it is named
    cut = _all_chunks if whole else _chunks
    pieces = F.when(F.length(norm) <= MAX_CHARS, F.array(norm)).otherwise(cut(F.when(F.length(norm) > MAX_CHARS, norm)))
    return rows.select(*df.columns, F.posexplode(pieces).alias("chunk_no", "chunk"))


def progress(done: Column, total: Column) -> Column:
    """Percent of the way, up to 90 before the final step."""
    return F.floor(done / total * 90 + 0.5).cast("int")


def facts(chunked: DataFrame, extract: str = "identity") -> DataFrame:
    """(.., fact_no, fact): what the named extractor finds in each chunk."""
    return chunked.select("*", F.posexplode(extractor(extract)(F.col("chunk"))).alias("fact_no", "fact"))


def ingest(jobs: DataFrame, files: DataFrame, existing: DataFrame, extract: str = "identity") -> DataFrame:
    """Index rows (memory_id, file_id, user_id, source, text) after the jobs: rows of the jobs' files are replaced.

    Ids come from file, place and text, so that a repeated job gives the same rows. jobs: (file_id, user_id, source);
    files: (file_id, text).
    """
    jobs = jobs.dropDuplicates(["file_id"])
    new = facts(chunk(jobs.join(files, "file_id")), extract).select(
        F.sha2(F.concat_ws("|", F.col("file_id").cast("string"), "chunk_no", "fact_no", "fact"), 256).alias("memory_id"), "file_id", "user_id", "source", F.col("fact").alias("text")
    )
    return existing.join(jobs, "file_id", "left_anti").select("memory_id", "file_id", "user_id", "source", "text").unionByName(new)


def growth_of(new: DataFrame, existing: DataFrame, as_of: Column) -> DataFrame:
    """One growth event per item that is new, none for items that were there."""
    fresh = new.dropDuplicates(["memory_id"]).join(existing.select("memory_id"), "memory_id", "left_anti")
    return fresh.select(F.col("memory_id").alias("id"), "user_id", F.lit(None).cast("string").alias("space_id"), "memory_id", as_of.alias("created_at"))


def job_status(results: DataFrame, attempts_allowed: int = 3) -> DataFrame:
    """(file_id, status, error): indexed on success; failed only once the attempts are used up, else pending again."""
    done = F.col("error").isNull()
    return results.select("file_id", F.when(done, "indexed").when(F.col("attempts") >= attempts_allowed, "failed").otherwise("pending").alias("status"), F.substring("error", 1, 500).alias("error"))
