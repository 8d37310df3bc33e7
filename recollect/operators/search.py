"""Permission-clamped vector search, exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import clamp, overlaps
from ..functions.joins import small
from ..functions.vectors import doubles, norm, scaled

#: Queries whose vectors a join may broadcast; more are joined by owner through a shuffle.
BROADCAST_QUERIES = 10_000


def effective_labels(requests: DataFrame) -> DataFrame:
    """Add what of the requested labels is granted."""
    return requests.withColumn("effective", clamp(F.col("requested"), F.col("granted")))


def filter_items(items: DataFrame, user_id=None, labels: list[str] | None = None) -> DataFrame:
    """Conditions of a plain search; no labels means no condition here, callers deny before."""
    if user_id is not None:
        items = items.where(F.col("user_id") == F.lit(user_id))
    return items.where(overlaps(F.col("space_ids"), F.array(*[F.lit(x) for x in labels]))) if labels else items


def top_k(queries: DataFrame, items: DataFrame, k: int = 10, same_id: bool = True) -> DataFrame:
    """(request_id, id, score, rank): the owner's k nearest items of each query.

    queries: (request_id, user_id, vector and, to clamp, effective); an empty ``effective`` finds nothing.
    Scores are rounded to six places and ties go to the lower id. Requests of one owner, vector and set of labels are one
    question, which is ranked once; requests then rank their question's hits alone. Per-group ranking keeps k rows a task
    before the shuffle (WindowGroupLimit).
    """
    if not 1 <= k <= 100:
        raise ValueError("k is between 1 and 100")
    clamped = "effective" in queries.columns
    q = queries.where(F.size("effective") > 0) if clamped else queries
    labels = [F.array_sort(F.array_distinct("effective")).alias("effective")] if clamped else []
    q = q.select("request_id", "user_id", "vector", F.xxhash64("user_id", "vector").alias("_v"), *labels)
    q = q.withColumn("_q", F.xxhash64("_v", "effective") if clamped else F.col("_v"))
    questions = q.groupBy("_q").agg(*[F.first(c).alias(c) for c in q.columns if c not in ("request_id", "_q")])
    # vectors are no more than questions, and hits no more than k times them
    few = questions.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    sized = F.broadcast if few else lambda df: df
    # each vector is measured once and each (item, query vector) pair scored once, however many questions ask with that vector
    asked = questions.groupBy("user_id", "_v").agg(F.first("vector").alias("vector")).select("user_id", "_v", doubles(F.col("vector")).alias("_w"), norm(F.col("vector")).alias("_nw"))
    asked = sized(asked) if few else small(asked, BROADCAST_QUERIES)
    kept = items.select("user_id", "id", *(["space_ids"] if clamped else []), doubles(F.col("vector")).alias("_i"), norm(F.col("vector")).alias("_ni"))
    scores = kept.join(asked, "user_id").select("id", "_v", *(["space_ids"] if clamped else []), F.round(scaled(F.col("_i"), F.col("_w"), F.col("_ni"), F.col("_nw")), 6).alias("score"))
    pairs = scores.join(sized(questions.select("_v", "_q", "effective")), "_v").where(overlaps(F.col("space_ids"), F.col("effective"))) if clamped else scores.withColumn("_q", F.col("_v"))
    # without its own item a request may need one rank more of its question
    best = pairs.select("_q", "id", "score").withColumn("rank", F.row_number().over(_nearest("_q"))).where(F.col("rank") <= (k if same_id else k + 1)).drop("rank")
    hits = q.select("request_id", "_q").join(sized(best), "_q")
    if not same_id:
        hits = hits.where("id <> request_id")
    return hits.select("request_id", "id", "score").withColumn("rank", F.row_number().over(_nearest("request_id"))).where(F.col("rank") <= k)


def _nearest(key: str):
    return Window.partitionBy(key).orderBy(F.desc("score"), "id")


def response(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, body): the hits as a JSON array in rank order."""
    rows = hits.join(items.select("id", "space_ids"), "id")
    body = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "space_ids"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["space_ids"].alias("spaces")))
    return rows.groupBy("request_id").agg(F.to_json(body).alias("body"))
