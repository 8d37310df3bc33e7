"""Jobs as batches: label backfills, ingest attempts with their states, cached reads, ends of streamed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import BACKFILL, HI, LO, backfill, stub_decision
from .ingest import ingest, job_status
from .limits import fixed_window
from .membership import apply_labels, stamp_growth

ATTEMPTS = 3


def backfill_job(memories: DataFrame, events: DataFrame, spaces: DataFrame, items: DataFrame, jobs: DataFrame, k: int = BACKFILL, hi: float = HI, lo: float = LO, decide: Column | None = None, ask: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, growth events, spaces) after the backfill jobs (space_id, attempts, error; null: it can run).

    A label's nearest items get it unless they were edited by hand, their unlabelled events get the first new label, and the
    label is no longer being reclassified. After an error it is so only once its attempts are used up, and nothing else changes.
    Candidates are kept by ``decide``, or by ``ask``, which gets their pairs and gives those to keep (as ``ask.confirmed_pairs``).
    """
    decide = stub_decision(hi, lo) if decide is None else decide
    runs = spaces.join(jobs.where("error IS NULL"), "space_id", "left_semi")
    near = backfill(items, runs, k, hi, lo)
    found = near.where((F.col("band") == "auto") | decide) if ask is None else near.where("band = 'auto'").unionByName(ask(near.where("band = 'candidate'")))
    labels = F.transform(F.array_sort(F.collect_set("space_id")), lambda x: x.cast("string"))
    new = found.groupBy(F.col("id").alias("memory_id")).agg(labels.alias("space_ids")).join(memories.where("NOT manual_override"), "memory_id", "left_semi")
    versions = spaces.select(F.col("space_id").cast("string").alias("space_id"), "version")
    ended = jobs.where(F.col("error").isNull() | (F.col("attempts") >= ATTEMPTS)).select("space_id", F.lit(True).alias("_ended")).distinct()
    after = spaces.join(ended, "space_id", "left").withColumn("reclassifying", F.col("reclassifying") & F.col("_ended").isNull()).select(*spaces.columns)
    return apply_labels(memories, new, versions, is_backfill=True), stamp_growth(events, new), after


def attempt(jobs: DataFrame, files: DataFrame, existing: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, states) after one attempt at the jobs (file_id, user_id, source); one broken file does not stop the others.

    files: (file_id, text, error of parsing or null); earlier: (file_id, status, attempts). What a job's file had in the index goes in
    any case. States (file_id, status, attempts, error): attempts go on from a pending state and start anew after any other. Jobs without a file are skipped.
    """
    jobs = jobs.dropDuplicates(["file_id"]).join(files, "file_id", "left_semi")
    before = earlier.where("status = 'pending'").select("file_id", F.col("attempts").alias("_before"))
    tried = jobs.join(files.select("file_id", "error"), "file_id").join(before, "file_id", "left")
    tried = tried.select("file_id", "error", (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("attempts"))
    states = job_status(tried, ATTEMPTS).join(tried.select("file_id", "attempts"), "file_id").select("file_id", "status", "attempts", "error")
    return ingest(jobs, files.where("error IS NULL").select("file_id", "text"), existing), states


def cached_reads(reads: DataFrame, key: str, ts: str, id_col: str, seconds: int = 60) -> DataFrame:
    """(id, key, hit): whether a read finds its key in a cache whose entries live so long from the read that filled them."""
    filled = fixed_window(reads, key, ts, id_col, 1, seconds)
    return filled.select(id_col, key, (~F.col("allowed")).alias("hit"))


def done_events(events: DataFrame) -> DataFrame:
    """(session, type, tool_calls): the closing event of each session both of whose answers have ended, with the tools it called in order. An ``error`` ends an answer too.

    events: (session, stream a or b, seq, type, name). A plain aggregation, so it is the same on a stream, in update or complete mode.
    """
    ends = F.bool_or(F.expr("stream = 'a' AND type IN ('plain_done', 'error')")) & F.bool_or(F.expr("stream = 'b' AND type IN ('memory_done', 'error')"))
    calls = F.array_sort(F.collect_list(F.when(F.col("type") == "memory_tool_start", F.struct("seq", "name"))))
    per = events.groupBy("session").agg(ends.alias("done"), F.transform(calls, lambda x: x["name"]).alias("tool_calls"))
    return per.where("done").select("session", F.lit("done").alias("type"), "tool_calls")
