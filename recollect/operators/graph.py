"""Entity graphs of an owner's items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plugins import get

MOST_ITEMS = 100


def first_items(items: DataFrame, user_id, most: int = MOST_ITEMS, id_col: str = "memory_id") -> DataFrame:
    """An owner's first items by id, which a graph view reads; vectors are not among their columns."""
    return items.where(F.col("user_id") == F.lit(user_id)).drop("vector").orderBy(id_col).limit(most)


def extracted(items: DataFrame, name: str = "neighbours", text_col: str = "text") -> DataFrame:
    """(user_id, g) for every item with a text."""
    return items.where(F.coalesce(F.col(text_col) != "", F.lit(False))).select("user_id", get("graph", name)(F.col(text_col)).alias("g"))


def vertices(graphs: DataFrame) -> DataFrame:
    """(user_id, id, name, type), no node twice."""
    return graphs.select("user_id", F.col("g.nodes").alias("nodes")).select("user_id", F.explode("nodes").alias("n")).groupBy("user_id", F.col("n.id").alias("id")).agg(F.min("n.name").alias("name"), F.min("n.type").alias("type"))


def edges(graphs: DataFrame) -> DataFrame:
    """(user_id, source, target, label, weight): links with how often they occur."""
    return graphs.select("user_id", F.col("g.links").alias("links")).select("user_id", F.explode("links").alias("l")).groupBy("user_id", "l.source", "l.target", "l.label").agg(F.count("*").alias("weight"))
