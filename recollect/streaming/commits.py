"""Changes of several tables that become visible together, and a sink of event-stream files that writes no line twice."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jobs import backfill_job


class Commits:
    """Tables as a base and numbered changes of rows by key: a batch's changes are staged, then one file with its number makes them visible.

    A reader lists the numbers once and sees of every table the rows of these batches only, so all of a batch or nothing. A
    batch that is replayed before its commit replaces what it staged; after it, ``commit`` does nothing.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, str]]):
        """tables: name to (base, its key column)."""
        self.spark, self.root, self.tables = spark, root, tables

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder, fs = self._path(f"{self.root}/_commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def read(self, numbers: list[int] | None = None) -> dict[str, DataFrame]:
        """All tables as of the committed batches (or the given ones)."""
        numbers, out = self.numbers() if numbers is None else numbers, {}
        for name, (base, key) in self.tables.items():
            out[name] = base
            if numbers:
                changes = self.spark.read.schema(base.withColumn("_batch", F.lit(0).cast("long")).schema).parquet(*[f"{self.root}/{name}/{n}" for n in numbers])
                newest = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch")))).where("_r = 1").drop("_r", "_batch")
                out[name] = base.join(newest.select(key), key, "left_anti").select(*base.columns).unionByName(newest)
        return out

    def stage(self, number: int, name: str, before: DataFrame, after: DataFrame) -> None:
        """Write the rows of ``after`` that are new or differ from ``before``."""
        key, mark = self.tables[name][1], F.xxhash64(F.to_json(F.struct(*after.columns), {"ignoreNullFields": "false"}))
        old = before.select(F.col(key).alias("_key"), mark.alias("_mark"))
        changed = after.withColumn("_new", mark).join(old, F.col(key).eqNullSafe(F.col("_key")), "left").where(~F.col("_new").eqNullSafe(F.col("_mark")))
        changed.select(*after.columns, F.lit(number).cast("long").alias("_batch")).write.mode("overwrite").parquet(f"{self.root}/{name}/{number}")

    def commit(self, number: int) -> None:
        done, fs = self._path(f"{self.root}/_commits/{number}")
        if not fs.exists(done):
            fs.create(done, True).close()


def backfill_stream(jobs: DataFrame, commits: Commits, items: DataFrame, checkpoint: str, after_write: Callable[[str], None] = lambda name: None, **options):
    """Backfill jobs (space_id, attempts, error) of a stream. Of every batch the memories, growth events and labels change together.

    ``commits`` holds the tables ``memories``, ``events`` and ``spaces``; ``options`` are those of ``backfill_job``. ``after_write`` is called with the name of each step once it is done.
    """

    def put(batch: DataFrame, number: int) -> None:
        if number in commits.numbers():
            return
        before = commits.read()
        for name, after in zip(("memories", "events", "spaces"), backfill_job(before["memories"], before["events"], before["spaces"], items, batch, **options), strict=True):
            commits.stage(number, name, before[name], after)
            after_write(name)
        commits.commit(number)
        after_write("commit")

    return jobs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class EventFiles:
    """Foreach writer of event-stream lines, a file for each epoch and partition in a folder that all executors share.

    Lines go to a file of this attempt's own that gets its name when the partition is whole; an epoch that is replayed finds the name taken and
    writes nothing. Spark deals the rows of a replayed epoch to the same partitions as long as the source and the plan do.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, partition: int, epoch: int) -> bool:
        os.makedirs(self.folder, exist_ok=True)
        self.path = f"{self.folder}/{epoch:010d}-{partition:05d}.txt"
        if os.path.exists(self.path):
            return False
        self.mine = f"{self.path}.{os.getpid()}.part"
        self.file = open(self.mine, "w", encoding="utf-8", newline="")
        return True

    def process(self, row: Row) -> None:
        self.file.write(row["value"])

    def close(self, error: Exception | None) -> None:
        if getattr(self, "file", None):
            self.file.close()
            os.remove(self.mine) if error else os.replace(self.mine, self.path)
            self.file = None


def write_events(lines: DataFrame, folder: str, checkpoint: str):
    """Stream lines (value: ``data: {json}`` and a blank line, as ``as_event_lines`` gives) to files of ``folder``."""
    return lines.select("value").writeStream.foreach(EventFiles(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
