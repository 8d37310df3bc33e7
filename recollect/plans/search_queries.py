"""Search, classification and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import moment
from ..functions.vectors import normalize
from ..operators import access as a
from ..operators import classify as c
from ..operators import cluster as k
from ..operators import search as se
from ..sources import domain as dom


def now():
    return moment(dom.AS_OF)

HI, LO = 0.30, 0.15


def _asked(s, d):
    """Every live connection asking; the query vector is the owner's first anchor's."""
    own = a.with_grants(dom.connections(s, d).where("NOT revoked"), dom.grants(s, d))
    v = dom.vector_spaces(s, d).where("space_id < 10").select("user_id", F.col("description_vector").alias("vector"))
    wish = F.when(F.col("id") % 2 == 0, F.array(F.col("user_id").cast("string"), F.lit("999")))
    req = own.join(v, "user_id", "left").select(F.col("id").alias("request_id"), F.col("id").alias("connection_id"), "user_id", "vector", F.concat(F.lit("query "), F.col("label")).alias("query"), wish.alias("requested"), F.col("space_ids").alias("granted"))
    return se.effective_labels(req)


def _granted(s, d):
    return se.top_k(_asked(s, d), dom.items(s, d), 10)


def _denied(s, d):
    return se.top_k(_asked(s, d).where(F.size("effective") == 0), dom.items(s, d), 10)


def _queries(s, d):
    return dom.vector_spaces(s, d).select(F.col("space_id").alias("request_id"), "user_id", F.col("description_vector").alias("vector"))


def _centroids(s, d):
    return dom.vector_spaces(s, d).where("space_id < 8").select(F.col("space_id").cast("int").alias("cluster"), normalize(F.col("description_vector")).alias("centroid"))


def _assigned(s, d):
    return k.assign(dom.items(s, d), _centroids(s, d))


def _suggest(s, d):
    """Suggestions for every owner, in one job."""
    pts = dom.items(s, d).withColumn("text", F.concat(F.lit("memory number"), F.col("id").cast("string")))
    return k.suggest(pts).withColumn("examples", F.array_join("examples", "|"))


QUERIES = {
    "search_topk": lambda s, d: se.top_k(_queries(s, d), dom.items(s, d), 10),
    "search_filtered": lambda s, d: se.filter_items(dom.points(s, d), 3, ["3"]).select("id", "user_id"),
    "search_granted": _granted,
    "search_denied": _denied,
    "search_response": lambda s, d: se.response(_granted(s, d), dom.items(s, d)).select("request_id", F.posexplode(F.from_json("body", "array<struct<id:long,score:double,spaces:array<string>>>")).alias("place", "x")).select("request_id", "place", "x.id", "x.score", F.array_join("x.spaces", ",").alias("spaces")),
    "clamped_labels": lambda s, d: _asked(s, d).select("request_id", F.array_join("effective", ",").alias("effective")),
    "audit_rows": lambda s, d: a.audit_rows(_asked(s, d), _granted(s, d), now()),
    "classify_bands": lambda s, d: c.scores(dom.items(s, d), dom.vector_spaces(s, d), HI, LO).where("band <> 'none'").select("id", "space_id", "score", "band"),
    "classify_assign": lambda s, d: c.assign(dom.items(s, d), dom.vector_spaces(s, d), HI, LO).select("id", F.array_join("space_ids", ",").alias("space_ids")),
    "backfill_topk": lambda s, d: c.backfill(dom.items(s, d), dom.vector_spaces(s, d), 200, HI, LO),
    "primary_space": lambda s, d: c.primary_space(c.assign(dom.items(s, d), dom.vector_spaces(s, d), HI, LO)),
    "cluster_assign": _assigned,
    "cluster_centroid_sim": lambda s, d: k.assign(dom.items(s, d), k.centroids(dom.items(s, d), _assigned(s, d))).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("sim"), 3).alias("total_sim")),
    "cluster_representatives": lambda s, d: k.representatives(_assigned(s, d)),
    "cluster_sizes": lambda s, d: _assigned(s, d).groupBy("cluster").agg(F.count("*").alias("item_count")).where("item_count >= 2"),
    "suggest_k": lambda s, d: k.suggest_k(dom.items(s, d)),
    "suggest_spaces": _suggest,
}

_COS = "round(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))), 6)"
_SEARCH = dom.prelude("items", "vector_space")
_ASKED = dom.prelude("connection", "grants", "items") + """,
g AS (SELECT connection_id, list(space_id ORDER BY space_id) AS granted FROM grants GROUP BY 1),
asked AS (SELECT c.id AS request_id, c.id AS connection_id, c.user_id, v.description_vector AS qv, 'query ' || c.label AS query,
  CASE WHEN c.id % 2 = 0 THEN list_filter([CAST(c.user_id AS VARCHAR), '999'], lambda x: list_contains(coalesce(granted, []), x)) ELSE coalesce(granted, []) END AS effective
  FROM connection c LEFT JOIN g ON g.connection_id = c.id LEFT JOIN vector_space v ON v.space_id = c.user_id AND v.space_id < 10 WHERE NOT revoked),
hits AS (SELECT request_id, i.id, """ + _COS.format("i.vector", "qv") + """ AS score FROM asked JOIN items i USING (user_id) WHERE list_has_any(i.space_ids, effective)),
top AS (SELECT * FROM (SELECT request_id, id, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM hits) WHERE rank <= 10)
"""
SCORES = _SEARCH + f""", scores AS (SELECT i.id, v.space_id, {_COS.format('i.vector', 'v.description_vector')} AS score FROM items i JOIN vector_space v USING (user_id)),
bands AS (SELECT *, CASE WHEN score >= {HI} THEN 'auto' WHEN score >= {LO} THEN 'candidate' ELSE 'none' END AS band FROM scores),
kept AS (SELECT * FROM bands WHERE band = 'auto' OR band = 'candidate' AND score >= {(HI + LO) / 2})"""
_NEAR = _SEARCH + """, cen AS (SELECT CAST(space_id AS INTEGER) AS cluster, list_transform(description_vector, lambda x: x / sqrt(list_dot_product(description_vector, description_vector))) AS c FROM vector_space WHERE space_id < 8),
near AS (SELECT id, cluster, sim FROM (SELECT i.id, cluster, round(list_dot_product(i.vector, c), 6) AS sim FROM items i, cen) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster) = 1)"""
#: The whole clustering: drawn centres, then rounds until nothing changes; a state is one row an owner.
_DRAW = "CAST('0x' || substr(sha256('1|' || {0} || '|' || {1}), 1, 13) AS BIGINT) / 4503599627370496.0"
_NEAREST = "list_transform(v, lambda p: list_position(list_transform(centres, lambda c: list_dot_product(p, c)), list_max(list_transform(centres, lambda c: list_dot_product(p, c)))))"
_SUM = "list_transform([list_transform(range(len(v[1])), lambda i: list_sum(list_transform(list_filter(v, lambda p, j: nearest[j] = c), lambda p: p[i + 1])))], lambda s: list_transform(s, lambda x: x / CASE WHEN list_dot_product(s, s) = 0 THEN 1 ELSE sqrt(list_dot_product(s, s)) END))[1]"
_CLUSTERS = "WITH RECURSIVE " + dom.prelude("items").removeprefix("WITH ") + f""",
pts AS (SELECT user_id, list(id ORDER BY id) AS ids, list(vector ORDER BY id) AS v, count(*) AS n, CAST(least(floor(sqrt(count(*)) + 0.5), 8) AS INTEGER) AS k
  FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id) <= 500) GROUP BY 1 HAVING count(*) >= 3),
seeded AS (SELECT user_id, 1 AS t, [CAST(floor({_DRAW.format('user_id', 0)} * n) AS BIGINT) + 1] AS chosen FROM pts
  UNION ALL SELECT user_id, t + 1, list_append(chosen, coalesce(list_position(list_transform(cum, lambda x: x >= {_DRAW.format('user_id', 't')} * cum[-1]), true), 1))
  FROM (SELECT user_id, t, chosen, list_transform(range(n), lambda i: list_sum(w[1:i + 1])) AS cum FROM (SELECT s.user_id, t, chosen, n, list_transform(v, lambda p: pow(1 - list_max(list_transform(chosen, lambda c: list_dot_product(p, v[c]))), 2)) AS w
    FROM seeded s JOIN pts USING (user_id) WHERE t < k))),
turns AS (SELECT user_id, 0 AS turn, list_transform(chosen, lambda c: v[c]) AS centres, list_transform(v, lambda p: 1) AS found, true AS changed FROM seeded JOIN pts USING (user_id) WHERE t = k
  UNION ALL SELECT user_id, turn + 1, CASE WHEN nearest = found THEN centres ELSE list_transform(centres, lambda old, c: CASE WHEN list_contains(nearest, c) THEN {_SUM} ELSE old END) END, nearest, nearest <> found
  FROM (SELECT t.user_id, turn, found, v, centres, {_NEAREST} AS nearest FROM turns t JOIN pts USING (user_id) WHERE changed AND turn < 25))"""
ORACLE_SQL = {
    "search_topk": _SEARCH + f" SELECT request_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT v.space_id AS request_id, i.id, {_COS.format('i.vector', 'v.description_vector')} AS score, row_number() OVER (PARTITION BY v.space_id ORDER BY {_COS.format('i.vector', 'v.description_vector')} DESC, i.id) AS rank FROM items i JOIN vector_space v USING (user_id)) WHERE rank <= 10",
    "search_filtered": dom.prelude("points") + " SELECT id, user_id FROM points WHERE user_id = 3 AND list_contains(space_ids, '3')",
    "search_granted": _ASKED + " SELECT * FROM top",
    "search_denied": _ASKED + " SELECT * FROM top WHERE request_id IN (SELECT request_id FROM asked WHERE len(effective) = 0)",
    "search_response": _ASKED + " SELECT request_id, CAST(rank - 1 AS INTEGER) AS place, t.id, score, array_to_string(space_ids, ',') AS spaces FROM top t JOIN items i ON i.id = t.id",
    "clamped_labels": _ASKED + " SELECT request_id, array_to_string(effective, ',') AS effective FROM asked",
    "audit_rows": _ASKED + f""" SELECT request_id, connection_id, 'search' AS action, array_to_string(list_sort(effective), ',') AS space_ids, substr(to_base64(encode(query)), 1, 64) AS query_mark, sha256(query) AS query_hash,
  CAST(coalesce(n, 0) AS INTEGER) AS result_count, TIMESTAMP '{dom.AS_OF}' AS created_at FROM asked LEFT JOIN (SELECT request_id, count(*) AS n FROM top GROUP BY 1) USING (request_id)""",
    "classify_bands": SCORES + " SELECT id, space_id, score, band FROM bands WHERE band <> 'none'",
    "classify_assign": SCORES + " SELECT id, string_agg(CAST(space_id AS VARCHAR), ',' ORDER BY band <> 'auto', space_id) AS space_ids FROM kept GROUP BY 1",
    "backfill_topk": SCORES + " SELECT space_id, id, score, band, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY score DESC, id) AS rank FROM bands) WHERE rank <= 200 AND band <> 'none'",
    "primary_space": SCORES + " SELECT id, CAST(space_id AS VARCHAR) AS primary_space FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY band <> 'auto', space_id) = 1",
    "cluster_assign": _NEAR + " SELECT * FROM near",
    "cluster_centroid_sim": _NEAR + """, el AS (SELECT cluster, p, sum(x) AS x FROM (SELECT n.cluster, unnest(i.vector) AS x, unnest(range(len(i.vector))) AS p FROM near n JOIN items i USING (id)) GROUP BY 1, 2),
 arr AS (SELECT cluster, list(x ORDER BY p) AS s FROM el GROUP BY 1), cc AS (SELECT cluster, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM arr),
 again AS (SELECT id, cluster, sim FROM (SELECT i.id, cluster, round(list_dot_product(i.vector, c), 6) AS sim FROM items i, cc) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster) = 1)
 SELECT cluster, count(*) AS n, round(sum(sim), 3) AS total_sim FROM again GROUP BY 1""",
    "cluster_representatives": _NEAR + " SELECT cluster, CAST(rank AS INTEGER) AS rank, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, id) AS rank FROM near) WHERE rank <= 3",
    "cluster_sizes": _NEAR + " SELECT cluster, count(*) AS item_count FROM near GROUP BY 1 HAVING count(*) >= 2",
    "suggest_spaces": _CLUSTERS + """, ended AS (SELECT user_id, found FROM turns QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY turn DESC) = 1),
 each AS (SELECT user_id, unnest(found) AS c, unnest(ids) AS id, unnest(v) AS p FROM ended JOIN pts USING (user_id)),
 sums AS (SELECT user_id, c, list(x ORDER BY i) AS s FROM (SELECT user_id, c, i, sum(x) AS x FROM (SELECT user_id, c, unnest(p) AS x, unnest(range(len(p))) AS i FROM each) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 near AS (SELECT user_id, c, id, row_number() OVER (PARTITION BY user_id, c ORDER BY round(list_dot_product(p, s) / sqrt(list_dot_product(s, s)), 9) DESC, id) AS r FROM each JOIN sums USING (user_id, c))
 SELECT user_id, CAST(c - 1 AS INTEGER) AS cluster, arg_max('number' || id, length(CAST(id AS VARCHAR)) * 10 - r) FILTER (r <= 5) AS suggested_name, 'Memorias relacionadas' AS description, count(*) AS item_count,
  string_agg('memory number' || id, '|' ORDER BY r) FILTER (r <= 3) AS examples FROM near GROUP BY 1, 2 HAVING count(*) >= 2""",
    "suggest_k": dom.prelude("items") + " SELECT user_id, count(*) AS n, CAST(least(floor(sqrt(count(*)) + 0.5), 8) AS INTEGER) AS k FROM items GROUP BY 1 HAVING count(*) >= 3",
}
