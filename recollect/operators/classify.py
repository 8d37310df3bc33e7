"""Classification of items into overlapping labels by similarity bands."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import band, cosine

AUTO, CANDIDATE, BACKFILL = 0.75, 0.45, 200


def thresholds(env: Mapping[str, str] = os.environ) -> tuple[float, float]:
    """(hi, lo) from the environment, the defaults where it tells none or no number."""

    def number(name: str, default: float) -> float:
        try:
            return float(env.get(name) or default)
        except ValueError:
            return default

    return number("CLASSIFY_THRESHOLD_AUTO", AUTO), number("CLASSIFY_THRESHOLD_CANDIDATE", CANDIDATE)


#: Thresholds of operators that are given none, as the environment has them when this is loaded.
HI, LO = thresholds()


def scores(items: DataFrame, spaces: DataFrame, hi: float = HI, lo: float = LO) -> DataFrame:
    """(id, user_id, space_id, score, band) of each item with each of its owner's labels; an equi-join on the owner."""
    pairs = items.select("id", "user_id", "vector").join(spaces, "user_id")
    s = F.round(cosine(F.col("vector"), F.col("description_vector")), 6)
    return pairs.select("id", "user_id", "space_id", s.alias("score")).withColumn("band", band(F.col("score"), hi, lo))


def stub_decision(hi: float, lo: float) -> Column:
    """Offline stand-in of the model that decides candidates: the upper half of the band."""
    return F.col("score") >= (hi + lo) / 2


def assign(items: DataFrame, spaces: DataFrame, hi: float = HI, lo: float = LO, decide: Column | None = None) -> DataFrame:
    """(id, space_ids): auto labels first, then confirmed candidates, each in label order. Only candidates are decided."""
    decide = stub_decision(hi, lo) if decide is None else decide
    found = scores(items, spaces, hi, lo).where("band <> 'none'").where((F.col("band") == "auto") | decide)
    order = F.array_sort(F.collect_list(F.struct((F.col("band") != "auto").alias("c"), "space_id")))
    return found.groupBy("id").agg(F.transform(order, lambda x: x["space_id"].cast("string")).alias("space_ids"))


def primary_space(assigned: DataFrame) -> DataFrame:
    return assigned.select("id", F.element_at("space_ids", 1).alias("primary_space"))


def backfill(items: DataFrame, spaces: DataFrame, k: int = BACKFILL, hi: float = HI, lo: float = LO) -> DataFrame:
    """(space_id, id, score, band, rank): each label's k nearest items of its owner that are not out of band."""
    order = Window.partitionBy("space_id").orderBy(F.desc("score"), "id")
    return scores(items, spaces, hi, lo).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("band") != "none")).select("space_id", "id", "score", "band", "rank")
