"""Connections: grants, activity, audit, token resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_mark, token_key
from ..functions.times import time_ago


def with_grants(connections: DataFrame, grants: DataFrame) -> DataFrame:
    """Each connection with its granted label ids, an empty array where there is none."""
    ids = grants.groupBy("connection_id").agg(F.array_sort(F.collect_list("space_id")).alias("space_ids")).withColumnRenamed("connection_id", "id")
    return connections.join(ids, "id", "left").withColumn("space_ids", F.coalesce("space_ids", F.array().cast("array<string>")))


def access_activity(connections: DataFrame, log: DataFrame, top: int = 20) -> DataFrame:
    """Live connections by last use, never used ones first, with all-time calls."""
    recent = connections.where("NOT revoked").orderBy(F.col("last_seen").desc_nulls_first(), "id").limit(top)
    calls = log.groupBy("connection_id").agg(F.count("*").alias("n"))
    return recent.join(calls, recent["id"] == calls["connection_id"], "left").select("id", "label", "last_seen", F.coalesce("n", F.lit(0)).alias("total_calls")).orderBy(F.col("last_seen").desc_nulls_first(), "id")


def with_time_ago(df: DataFrame, as_of: Column, col: str = "last_seen") -> DataFrame:
    return df.withColumn("ago", time_ago(F.col(col), as_of))


def last_seen(log: DataFrame) -> DataFrame:
    """Derived last use of each connection."""
    return log.groupBy("connection_id").agg(F.max("created_at").alias("last_seen"))


def files_with_counts(files: DataFrame, memories: DataFrame) -> DataFrame:
    counts = memories.groupBy("file_id").agg(F.count("*").alias("n"))
    return files.join(counts, files["id"] == counts["file_id"], "left").select(*[files[c] for c in files.columns], F.coalesce("n", F.lit(0)).alias("memory_count"))


def grant_matrix(connections: DataFrame, spaces: DataFrame, grants: DataFrame) -> DataFrame:
    """(connection_id, space_id, granted) for live connections and their owner's labels."""
    pairs = connections.where("NOT revoked").select(F.col("id").alias("connection_id"), "user_id").join(spaces.select(F.col("space_id").cast("string"), "user_id"), "user_id")
    return pairs.join(grants.withColumn("granted", F.lit(True)), ["connection_id", "space_id"], "left").select("connection_id", "space_id", F.coalesce("granted", F.lit(False)).alias("granted"))


def resolve_tokens(requests: DataFrame, connections: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (token, ..) with the live connection whose key fits, its owner and grants; others are dropped."""
    live = with_grants(connections.where("NOT revoked"), grants).select(F.col("id").alias("connection_id"), "user_id", "token_hash", F.col("space_ids").alias("granted"))
    return requests.withColumn("token_hash", token_key(F.col("token"))).join(live, "token_hash").drop("token", "token_hash")


def audit_rows(requests: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """One row per request with its effective labels, the query's mark and digest, and the number of hits."""
    n = hits.groupBy("request_id").agg(F.count("*").alias("n"))
    return requests.join(n, "request_id", "left").select(
        "request_id", "connection_id", F.lit("search").alias("action"), F.array_join(F.array_sort("effective"), ",").alias("space_ids"), query_mark(F.col("query")).alias("query_mark"), F.sha2("query", 256).alias("query_hash"),
        F.coalesce("n", F.lit(0)).cast("int").alias("result_count"), as_of.alias("created_at"),
    )


def revoke(connections: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the connections of ``ids`` (id, user_id) revoked; others' connections stay as they are."""
    hit = ids.select("id", "user_id").distinct().withColumn("hit", F.lit(True))
    return connections.join(hit, ["id", "user_id"], "left").withColumn("revoked", F.col("revoked") | F.coalesce("hit", F.lit(False))).drop("hit").select(*connections.columns)


def grant(grants: DataFrame, new: DataFrame, connections: DataFrame, spaces: DataFrame) -> DataFrame:
    """Grants plus new pairs (connection_id, space_id) whose connection and label have one owner; none twice."""
    owned = new.join(connections.select(F.col("id").alias("connection_id"), "user_id"), "connection_id").join(spaces.select(F.col("space_id").cast("string"), "user_id"), ["space_id", "user_id"]).select("connection_id", "space_id")
    return grants.unionByName(owned.dropDuplicates().join(grants, ["connection_id", "space_id"], "left_anti"))


def ungrant(grants: DataFrame, gone: DataFrame) -> DataFrame:
    return grants.join(gone, ["connection_id", "space_id"], "left_anti")


def health(checks: DataFrame) -> DataFrame:
    """Overall state of (name, ok) rows."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).select("ok", F.when(F.col("ok"), "ok").otherwise("degraded").alias("status"))


def by_time(rows: DataFrame, newest: bool = True, time: str = "created_at", id_col: str = "id") -> DataFrame:
    """A listing by time, newest or oldest first; ties go to the lower id, rows without a time come last."""
    return rows.orderBy(F.desc_nulls_last(time) if newest else F.asc_nulls_last(time), id_col)
