"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step is a min-aggregation (combined before its shuffle, so a hub costs one row per task) and an
equi-join whose other side has one row per node (so AQE can split a hub's rows). Each round's edges are
written to the shared folder and read back: the plan stays short and lost executors lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

#: The steps halve distances; 40 rounds cover any graph that fits a cluster.
MAX_ROUNDS = 40


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    ``edges`` has columns a and b of one orderable type. Nulls, loops and repeated edges are ignored;
    no edges give an empty result.
    """
    good = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    at, seen = good.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    for i in range(MAX_ROUNDS + 1):
        told = Observation()  # counted while the round is written
        e = scratch.keep(at.observe(told, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        state = (told.get["n"], told.get["x"])
        if state == seen or not state[0]:
            break
        seen = state
        both = e.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        at = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
