"""Rate limits and one-time codes in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_window(hits: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Each hit with the hits of its key in the window that ends with it, and whether it is allowed; exact.

    Hits are counted by key and stretch of time, each stretch seeing the one before as well, so that a busy key is dealt to
    many tasks.
    """
    span = seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    place = F.explode(F.array(F.struct(F.floor(us / span).alias("n"), F.lit(True).alias("own")), F.struct((F.floor(us / span) + 1).alias("n"), F.lit(False).alias("own"))))
    w = Window.partitionBy(key, "_at.n").orderBy("_us").rangeBetween(-span, Window.currentRow)
    counted = hits.select("*", us.alias("_us"), place.alias("_at")).withColumn("hits", F.count("*").over(w)).where("_at.own")
    return counted.drop("_us", "_at").withColumn("allowed", F.col("hits") <= limit)


def fixed_window(hits: DataFrame, key: str, ts: str, id_col: str, limit: int, seconds: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, hit_no, allowed, *carry): windows start at a key's first hit and anew at the first hit after their end.

    Where a window starts depends on the one before, so a key's hits are folded in order, by state that is passed from batch
    to batch: sorted partitions stream through, whatever the size of a key. Null is a key like others; columns named in ``carry`` are passed on.
    """
    rows = hits.select(F.col(id_col).alias("c0"), F.col(key).alias("c1"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 2)])
    names = [c for c in rows.columns if c != "us"]
    schema = rows.select(*names).withColumns({"hit_no": F.lit(0).cast("long"), "allowed": F.lit(True)}).schema
    span = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = (), 0, 0
        for b in batches:
            nos = []
            for k, us in zip(b.column("c1").to_pylist(), b.column("us").to_pylist(), strict=True):
                if (k,) != last or us >= start + span:
                    last, start, n = (k,), us, 0
                n += 1
                nos.append(n)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(nos, pa.int64()), pa.array([x <= limit for x in nos], pa.bool_())], names=[*names, "hit_no", "allowed"])

    folded = rows.repartition("c1").sortWithinPartitions("c1", "us", "c0").mapInArrow(fold, schema)
    return folded.select(F.col("c0").alias(id_col), F.col("c1").alias(key), "hit_no", "allowed", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry, 2)])


def both_limits(hits: DataFrame, keys: tuple[str, str], ts: str, id_col: str, limit: int = 5, seconds: int = 3600) -> DataFrame:
    """(id, allowed), one row a hit: each hit counts against both keys' fixed windows and passes only if both allow it."""
    one = fixed_window(hits.select(id_col, *keys, F.col(ts).cast("timestamp").alias("_ts")), keys[0], "_ts", id_col, limit, seconds, (keys[1], "_ts")).withColumnRenamed("allowed", "_first")
    return fixed_window(one, keys[1], "_ts", id_col, limit, seconds, ("_first",)).select(id_col, (F.col("_first") & F.col("allowed")).alias("allowed"))


def latest_code(codes: DataFrame, as_of: Column) -> DataFrame:
    """The newest unconsumed, unexpired code of each key; a code that expires right now is expired."""
    live = codes.where(F.col("consumed_at").isNull() & (F.col("expires_at") > as_of))
    w = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("id"))
    return live.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def code_attempts(tries: DataFrame, most: int = 5) -> DataFrame:
    """tries (code_id, try_no, correct): outcome of each try. Tries count before they are judged; the sixth is
    rejected unseen, and a code that was used is gone."""
    before = Window.partitionBy("code_id").orderBy("try_no").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.max(F.col("correct") & (F.col("try_no") <= most)).over(before), F.lit(False))
    return tries.select("code_id", "try_no", F.when(used, "consumed").when(F.col("try_no") > most, "too_many").when(F.col("correct"), "ok").otherwise("wrong").alias("outcome"))


def expiry(created: Column, minutes: int = 10) -> Column:
    return created + F.expr(f"INTERVAL {minutes} MINUTES")
