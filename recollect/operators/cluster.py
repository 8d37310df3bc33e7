"""Spherical clustering of items and label suggestions."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, dot
from ..plugins import get

MAX_K, ROUNDS, SAMPLE, LEAST_POINTS = 8, 25, 500, 3
#: Texts shown to the naming plug-in, kept as examples, and characters of each.
SHOWN, TEXT, EXAMPLES, EXAMPLE = 5, 200, 3, 120
DEFAULT_NAME, DEFAULT_DESCRIPTION = "Espacio", "Memorias relacionadas"


def suggest_k(points: DataFrame) -> DataFrame:
    """(user_id, n, k): as many clusters as the rounded root of the points, at most eight; too few points give none."""
    n = points.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_POINTS)
    return n.withColumn("k", F.least(F.floor(F.sqrt("n") + 0.5), F.lit(MAX_K)).cast("int"))


def usable_points(points: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` points an owner with a vector and a text, first by id. The row number is a limit to every task before the shuffle, so that
    an owner of very many points does not gather in one."""
    w = Window.partitionBy("user_id").orderBy("id")
    return points.where((F.size("vector") > 0) & (F.length("text") > 0)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster, sim): the centroid (cluster, centroid) of greatest dot product, lowest number on ties.

    Centroids with an owner are joined by owner; without one they are a single run's, at most MAX_K rows, which is checked.
    """
    pairs = points.join(centroids, "user_id") if "user_id" in centroids.columns else points.crossJoin(F.broadcast(centroids))
    if "user_id" not in centroids.columns and centroids.limit(MAX_K + 1).count() > MAX_K:
        raise ValueError(f"more than {MAX_K} centroids")
    sim = F.round(dot(F.col("vector"), F.col("centroid")), 6)
    best = pairs.select("id", "cluster", sim.alias("sim")).groupBy("id").agg(F.max(F.struct("sim", (-F.col("cluster")).alias("c"))).alias("b"))
    return best.select("id", (-F.col("b.c")).alias("cluster"), F.col("b.sim").alias("sim"))


def centroids(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, centroid): sums of members, to unit length."""
    parts = points.join(assigned, "id").select("cluster", F.posexplode(doubles(F.col("vector"))).alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    arrays = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))
    size = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return arrays.select("cluster", F.transform("s", lambda x: F.when(size == 0, x).otherwise(x / size)).alias("centroid"))


def representatives(assigned: DataFrame, k: int = 3) -> DataFrame:
    """(cluster, rank, id, sim): the members nearest to their centroid."""
    w = Window.partitionBy("cluster").orderBy(F.desc("sim"), "id")
    return assigned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cluster", "rank", "id", "sim")


def draw(seed: int, owner: str, n: int) -> float:
    """The n-th random number of an owner, from 0 to below 1; any engine with SHA-256 can repeat it."""
    return int(sha256(f"{seed}|{owner}|{n}".encode()).hexdigest()[:13], 16) / 2**52


def spherical_k_means(vectors: np.ndarray, k: int, seed: int, owner: str) -> np.ndarray:
    """The cluster of each vector of one owner. The first centre is drawn at random, each next one by (1 - greatest product)**2; a vector goes to the centre of
    the greatest product, the first one on ties; a centre is its members' sum at unit length, or stays where it has none. Ends when
    nothing changes or after ``ROUNDS`` rounds. At most k vectors are a cluster each."""
    n = len(vectors)
    if n <= k:
        return np.arange(n)
    chosen = [int(draw(seed, owner, 0) * n)]
    while len(chosen) < k:
        passed = np.cumsum((1 - (vectors @ vectors[chosen].T).max(1)) ** 2)
        at = int(np.searchsorted(passed, draw(seed, owner, len(chosen)) * passed[-1]))
        chosen.append(at if at < n else 0)
    centres, found = vectors[chosen], np.zeros(n, np.int64)
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(1)
        if (nearest == found).all():
            break
        found = nearest
        sums = np.stack([vectors[found == c].sum(0) for c in range(k)])
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(np.bincount(found, minlength=k)[:, None] == 0, centres, sums / np.where(size == 0, 1, size))
    return found


def owners_clusters(points: DataFrame, seed: int = 1) -> DataFrame:
    """(user_id, id, text, cluster, sim): clusters of every owner's points (user_id, id, vector, text) in one job, a group an owner.

    Owners with fewer than ``LEAST_POINTS`` usable points have none. ``sim`` is the product with the cluster's sum at unit length. Null vectors, empty texts and
    vectors of another length than the owner's first one are no points; null owners are one owner.
    """
    few = usable_points(points.select("user_id", "id", doubles(F.col("vector")).alias("vector"), F.substring("text", 1, TEXT).alias("text")))
    schema = few.select("user_id", "id", "text", F.lit(0).alias("cluster"), F.lit(0.0).alias("sim")).schema

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        sizes = pc.list_value_length(rows["vector"])
        rows = rows.filter(pc.equal(sizes, sizes[0]))
        rows = rows.slice(0, rows.num_rows if rows.num_rows >= LEAST_POINTS else 0)
        n = rows.num_rows
        vectors = pc.list_flatten(rows["vector"]).to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
        found, sim = spherical_k_means(vectors, min(int(n**0.5 + 0.5), MAX_K), seed, str(rows["user_id"][0].as_py())) if n else np.zeros(0, int), np.zeros(n)
        for c in set(found.tolist()):
            total = vectors[found == c].sum(0)
            sim[found == c] = vectors[found == c] @ (total / (np.sqrt((total**2).sum()) or 1))
        return rows.select(["user_id", "id", "text"]).append_column("cluster", pa.array(found, pa.int32())).append_column("sim", pa.array(sim))

    return few.groupBy("user_id").applyInArrow(group, schema)


def suggest(points: DataFrame, seed: int = 1, name: str = "reply_of_longest_word") -> DataFrame:
    """(user_id, cluster, suggested_name, description, item_count, examples): a suggestion for each cluster of two or more of every owner.

    The named plug-in replies to the five texts nearest to the centre, one a line; a reply that is no JSON object, or lacks a part, gives the default. Three of the texts are the examples.
    """
    near = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("sim", 9)).alias("far"), "id", "text"))), 1, SHOWN)
    each = owners_clusters(points, seed).groupBy("user_id", "cluster").agg(F.count("*").alias("item_count"), near.alias("near")).where("item_count >= 2")
    sample = F.array_join(F.transform("near", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    reply = each.withColumn("said", F.from_json(get("reply", name)(sample), "name string, description string"))
    return reply.select(
        "user_id", "cluster", F.coalesce("said.name", F.lit(DEFAULT_NAME)).alias("suggested_name"), F.coalesce("said.description", F.lit(DEFAULT_DESCRIPTION)).alias("description"),
        "item_count", F.transform(F.slice("near", 1, EXAMPLES), lambda x: F.substring(x["text"], 1, EXAMPLE)).alias("examples"),
    )


def spread_weights(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, weight): squared cosine distance to the nearest of the chosen centroids, by which k-means++ draws the next one."""
    return assign(points, chosen).select("id", ((1 - F.col("sim")) * (1 - F.col("sim"))).alias("weight"))
