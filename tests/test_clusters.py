"""Clustering of all owners against a plain version of its rules, without numpy."""

import math
import random

from pyspark.sql import functions as F

from recollect import plugins
from recollect.operators import cluster


def plain_k_means(vectors, k, seed, owner):
    n = len(vectors)
    if n <= k:
        return list(range(n))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    chosen = [int(cluster.draw(seed, owner, 0) * n)]
    while len(chosen) < k:
        weights = [min(1 - dot(v, vectors[c]) for c in chosen) ** 2 for v in vectors]
        left, at = cluster.draw(seed, owner, len(chosen)) * sum(weights), 0
        for i, w in enumerate(weights):
            left -= w
            if left <= 0:
                at = i
                break
        chosen.append(at)
    centres, found = [vectors[c] for c in chosen], [0] * n
    for _ in range(25):
        nearest = [max(range(k), key=lambda c: (dot(v, centres[c]), -c)) for v in vectors]
        if nearest == found:
            break
        found = nearest
        for c in range(k):
            if mine := [v for v, f in zip(vectors, found, strict=True) if f == c]:
                total = [sum(x) for x in zip(*mine, strict=True)]
                size = math.sqrt(dot(total, total))
                centres[c] = [x / size for x in total] if size else total
    return found


def unit(rng, dims):
    v = [rng.gauss(0, 1) for _ in range(dims)]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def test_by_brute_force(spark):
    """Owners of many sizes, one with ties only, one with more points than are used, one without a number."""
    rng = random.Random(5)
    sizes = {1: 2, 2: 3, 3: 7, 4: 40, 5: 61, None: 12, 7: 520}
    rows = [(u, i * 10 + (u or 0), unit(rng, 5), f"text {u} {i}") for u, n in sizes.items() for i in range(n)] + [(9, 100 + i, [1.0, 0.0, 0.0, 0.0, 0.0], "same") for i in range(9)]
    rows += [(3, -1, None, "no vector"), (3, -2, [], "no vector"), (3, -3, unit(rng, 5), ""), (3, -4, unit(rng, 5), None), (3, 10**6, unit(rng, 4), "another length")]
    pts = spark.createDataFrame(rows, "user_id long, id long, vector array<double>, text string").repartition(5)
    got = {(r["user_id"], r["id"]): r["cluster"] for r in cluster.owners_clusters(pts, seed=3).collect()}
    want = {}
    for u in [*sizes, 9]:
        mine = sorted((r for r in rows if r[0] == u and r[2] and len(r[2]) == 5 and r[3]), key=lambda r: r[1])[:500]
        if len(mine) >= 3:
            k = min(int(math.sqrt(len(mine)) + 0.5), 8)
            want |= {(u, r[1]): c for r, c in zip(mine, plain_k_means([r[2] for r in mine], k, 3, str(u)), strict=True)}
    assert got == want and len({c for (u, _), c in got.items() if u == 7}) > 3
    assert {c for (u, _), c in got.items() if u == 9} == {0}


def test_ten_thousand_owners_in_one_job(spark):
    """No owner passes through the driver: one stage of jobs, whatever their number."""
    pts = spark.range(30_000).select((F.col("id") % 10_000).alias("user_id"), "id", F.array(F.sin("id"), F.cos("id")).alias("vector"), F.concat(F.lit("memory number"), "id").alias("text"))
    out = cluster.suggest(pts)
    rows = out.agg(F.countDistinct("user_id").alias("owners"), F.sum("item_count").alias("points"), F.max(F.size("examples")).alias("most"), F.min("item_count").alias("least")).first()
    assert rows["owners"] == 10_000 and rows["least"] >= 2 and rows["most"] in (2, 3) and 20_000 <= rows["points"] <= 30_000


def test_names_and_defaults(spark):
    pts = spark.createDataFrame([(1, i, [1.0, i / 100] if i % 2 else [i / 100, 1.0], f"word{i} alphabet" if i % 2 else "a b c") for i in range(10)], "user_id long, id long, vector array<double>, text string")
    got = {r["suggested_name"]: r for r in cluster.suggest(pts).collect()}
    assert set(got) == {"alphabet", "Espacio"} and all(r["description"] == "Memorias relacionadas" and r["item_count"] >= 2 for r in got.values())
    assert got["alphabet"]["examples"][0].endswith("alphabet") and len(got["alphabet"]["examples"]) == 3

    @plugins.register("reply", "told")
    def told(sample):
        return F.lit('{"name": "N", "description": "D", "more": 1}')

    assert {(r["suggested_name"], r["description"]) for r in cluster.suggest(pts, name="told").collect()} == {("N", "D")}
    assert cluster.suggest(pts.where("id < 2")).count() == 0 and cluster.suggest(pts.limit(0)).count() == 0
    long = cluster.suggest(pts.withColumn("text", F.repeat(F.lit("x"), 1000))).first()
    assert {len(e) for e in long["examples"]} == {cluster.EXAMPLE}
