"""Structured Streaming forms of the queues, the growth view, the limiter and the stream merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import ingest
from ..operators.jobs import attempt
from ..schemas import schema


def enqueue(jobs: DataFrame, path: str) -> None:
    """Append jobs to the landing folder that a stream reads."""
    jobs.write.mode("append").json(path)


def job_queue(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.readStream.schema(schema(kind)).option("maxFilesPerTrigger", 100).json(path)


def ingest_stream(queue: DataFrame, files: DataFrame, index_path: str, checkpoint: str):
    """Index the files of queued jobs. Every batch writes its items under its own number, so that a replayed batch
    replaces what it wrote, and its files' older rows are hidden by the readers' newest-batch rule (``current_index``)."""

    def put(batch: DataFrame, number: int) -> None:
        _put_index(ingest(batch, files, batch.sparkSession.createDataFrame([], INDEX)), batch, f"{index_path}/batch={number}")

    return queue.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INDEX = "memory_id string, file_id string, user_id string, source string, text string"


def _put_index(items: DataFrame, jobs: DataFrame, path: str) -> None:
    """Write a batch's items, and for each file of its jobs a row without item, which hides older rows of files that have none now."""
    marks = jobs.select("file_id").distinct().select(*[F.col(c) if c == "file_id" else F.lit(None).cast("string").alias(c) for c in ("memory_id", "file_id", "user_id", "source", "text")])
    items.unionByName(marks).write.mode("overwrite").parquet(path)


STATE = "file_id string, status string, attempts int, error string, batch int, step int"


def attempt_stream(queue: DataFrame, files: DataFrame, index_path: str, state_path: str, checkpoint: str):
    """Like ``ingest_stream``, with the states of files (``current_states``): processing while their batch is at work, then indexed, failed,
    or pending where a job may be queued again. files: (file_id, text, error of parsing or null). A replayed batch replaces what it
    wrote and reads the states before it; an error of one file leaves the others alone."""
    spark = queue.sparkSession
    spark.createDataFrame([], STATE).write.mode("ignore").partitionBy("batch", "step").parquet(state_path)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = latest(session.read.schema(STATE).parquet(state_path).where(F.col("batch") < number))
        index, states = attempt(batch, files, session.createDataFrame([], INDEX), earlier)
        known = batch.select("file_id").distinct().join(files, "file_id", "left_semi")
        started = known.select("file_id", F.lit("processing").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
        started.write.mode("overwrite").parquet(f"{state_path}/batch={number}/step=0")
        _put_index(index, known, f"{index_path}/batch={number}")
        states.write.mode("overwrite").parquet(f"{state_path}/batch={number}/step=1")

    return queue.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(states: DataFrame) -> DataFrame:
    """Each file's newest state."""
    newest = F.max_by(F.struct("status", "attempts", "error"), F.struct("batch", "step"))
    return states.groupBy("file_id").agg(newest.alias("s")).select("file_id", "s.*")


def current_states(spark: SparkSession, state_path: str) -> DataFrame:
    return latest(spark.read.schema(STATE).parquet(state_path))


def current_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The items of each file's latest batch, none where that batch found none."""
    rows = spark.read.schema(f"{INDEX}, batch int").parquet(index_path)
    latest = rows.groupBy("file_id").agg(F.max("batch").alias("batch"))
    return rows.where("memory_id IS NOT NULL").join(latest, ["file_id", "batch"]).drop("batch")


def growth_view(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(bucket, space_id, count) of an event stream with a timestamp column created_at."""
    ts = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return ts.groupBy(F.window("created_at", width).alias("w"), "space_id").agg(F.count("*").alias("count")).select(F.col("w.start").alias("bucket"), "space_id", "count")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two streams of tagged events as one."""
    return a.withColumn("stream", F.lit("a")).unionByName(b.withColumn("stream", F.lit("b")))


def limiter_stream(hits: DataFrame, limit: int = 30, seconds: int = 60, expire: bool = True) -> DataFrame:
    """hits (key, id, us: microseconds): the fixed-window limit on a stream. Per key the state tells when its window
    started and how many hits it had; with ``expire`` it goes once the key has been silent for two windows (not with
    a trigger that ends, which would wait for it)."""
    span = seconds * 1_000_000

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        out = []
        for us, hit in sorted((int(us), int(hit)) for pdf in rows for us, hit in zip(pdf["us"], pdf["id"], strict=True)):
            if start is None or us >= start + span:
                start, n = us, 0
            n += 1
            out.append((key[0], hit, n, n <= limit))
        state.update((start, n))
        if expire:
            state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame(out, columns=["key", "id", "hit_no", "allowed"])

    return hits.groupBy("key").applyInPandasWithState(fold, "key string, id long, hit_no int, allowed boolean", "start long, n int", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def post_rows(rows: DataFrame, send: Callable[[str], bool], refused_path: str, checkpoint: str):
    """Post every row as JSON from the tasks; bodies that ``send`` refuses (false) or fails on are kept with the error.

    ``send`` gets one body and is shipped with the job. A replayed batch posts again, so the other side sees each row at least once; its refused
    rows replace those that it wrote before.
    """

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for body in b["body"]:
                try:
                    error = None if send(body) else "refused"
                except Exception as e:  # an unreachable other side is that row's error
                    error = f"{type(e).__name__}: {e}"
                if error:
                    out.append((body, error))
            yield pd.DataFrame(out, columns=["body", "error"])

    def put(batch: DataFrame, number: int) -> None:
        bodies = batch.select(F.to_json(F.struct(*batch.columns)).alias("body"))
        bodies.mapInPandas(post, "body string, error string").write.mode("overwrite").parquet(f"{refused_path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
