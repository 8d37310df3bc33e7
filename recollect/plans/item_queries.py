"""Connection, file, grant, page and code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_key
from ..functions.times import moment
from ..operators import access as a
from ..operators import limits as li
from ..operators import membership as m
from ..sources import domain as dom
from ..sources.readers import accepted_file, first_match, load, lookup


def now():
    return moment(dom.AS_OF)

PAGE = ("en", 7, 157)


def _time_ago(s, d):
    recent = load(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    some = recent.withColumn("last_seen", F.when(F.col("user_id") % 7 != 0, F.col("last_seen")))
    return a.with_time_ago(some, now()).select("user_id", "ago")


def _codes(s, d):
    e = load(s, d, "events")

    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("consumed_at"))


def _tokens(s, d):
    """Every customer asks with its own token, and under its negative number with one that nobody holds."""
    live = dom.connections(s, d).withColumn("token_hash", token_key(F.concat(F.lit("token-"), F.col("label"))))
    c = load(s, d, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("token-"), F.col("c_name")).alias("token"))
    asked = c.unionByName(c.select((-F.col("request_id")).alias("request_id"), F.lit("token-unknown").alias("token")))
    return a.resolve_tokens(asked, live, dom.grants(s, d)).select("request_id", "connection_id", "user_id", F.array_join("granted", ",").alias("granted"))


def _grants_after(s, d):
    """Every connection asks for label 3; then label 13 is withdrawn from all."""
    new = dom.connections(s, d).select(F.col("id").alias("connection_id"), F.lit("3").alias("space_id"))
    after = a.grant(dom.grants(s, d), new, dom.connections(s, d), dom.vector_spaces(s, d))
    return a.ungrant(after, dom.connections(s, d).select(F.col("id").alias("connection_id"), F.lit("13").alias("space_id")))


QUERIES = {
    "access_activity": lambda s, d: a.access_activity(dom.connections(s, d), dom.access_log(s, d)),
    "connections_with_grants": lambda s, d: a.with_grants(dom.connections(s, d), dom.grants(s, d)).select("id", "label", "revoked", F.array_join("space_ids", ",").alias("space_ids")),
    "files_with_counts": lambda s, d: a.files_with_counts(dom.files(s, d), dom.memory_index(s, d)).select("id", "name", "memory_count"),
    "grant_matrix": lambda s, d: a.grant_matrix(dom.connections(s, d), dom.vector_spaces(s, d), dom.grants(s, d)),
    "time_ago": _time_ago,
    "last_seen": lambda s, d: a.last_seen(dom.access_log(s, d)),
    "space_items_page": lambda s, d: m.space_items_page(dom.memory_index(s, d), *PAGE, limit=20).select("memory_id", "created_at"),
    "other_spaces": lambda s, d: m.other_spaces(dom.memory_index(s, d), dom.memory_spaces(s), "en"),
    "latest_code": lambda s, d: li.latest_code(_codes(s, d), now()).select("key", "id"),
    "token_resolution": _tokens,
    "grants_after_changes": _grants_after,
    "revoke_connections": lambda s, d: a.revoke(dom.connections(s, d), dom.connections(s, d).where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"))).select("id", "revoked"),
    "accepted_files": lambda s, d: dom.files(s, d).select("id", accepted_file(F.when(F.col("id") % 3 == 0, "text/plain").when(F.col("id") % 3 == 1, "image/png").otherwise("application/pdf"), F.col("size_bytes")).alias("accepted")),
    "lookup_document": lambda s, d: lookup(load(s, d, "documents"), "doc_id", 42).select("doc_id", "lang", "n_chars"),
    "first_match": lambda s, d: first_match(load(s, d, "documents"), "doc_id", lang="de").select("doc_id"),
    "health": lambda s, d: a.health(load(s, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") >= 0).alias("ok"))),
}

_CONN = dom.prelude("connection", "access_log")
_RECENT = "recent AS (SELECT * FROM connection WHERE NOT revoked ORDER BY last_seen DESC NULLS FIRST, id LIMIT 20)"
ORACLE_SQL = {
    "access_activity": _CONN + f", {_RECENT} SELECT id, label, last_seen, coalesce(n, 0) AS total_calls FROM recent LEFT JOIN (SELECT connection_id, count(*) AS n FROM access_log GROUP BY 1) ON connection_id = id",
    "connections_with_grants": dom.prelude("connection", "grants") + " SELECT id, label, revoked, coalesce(g, '') AS space_ids FROM connection LEFT JOIN (SELECT connection_id, string_agg(space_id, ',' ORDER BY space_id) AS g FROM grants GROUP BY 1) ON connection_id = id",
    "files_with_counts": dom.prelude("files", "memory_index") + " SELECT id, name, coalesce(n, 0) AS memory_count FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM memory_index GROUP BY 1) ON file_id = id",
    "grant_matrix": dom.prelude("connection", "grants") + " SELECT c.id AS connection_id, CAST(s.space_id AS VARCHAR) AS space_id, g.space_id IS NOT NULL AS granted FROM connection c JOIN vector_space s USING (user_id) LEFT JOIN grants g ON g.connection_id = c.id AND g.space_id = CAST(s.space_id AS VARCHAR) WHERE NOT revoked",
    "time_ago": f"""WITH t AS (SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS seen FROM events GROUP BY 1),
  m AS (SELECT user_id, seen, CAST(floor((epoch_us(TIMESTAMP '{dom.AS_OF}') - epoch_us(seen)) / 60000000) AS BIGINT) AS m FROM t)
  SELECT user_id, CASE WHEN seen IS NULL THEN 'nunca' WHEN m < 1 THEN 'ahora' WHEN m < 60 THEN 'hace ' || m || 'm' WHEN m // 60 < 24 THEN 'hace ' || (m // 60) || 'h' ELSE 'hace ' || (m // 60 // 24) || 'd' END AS ago FROM m""",
    "last_seen": dom.prelude("access_log") + " SELECT connection_id, max(created_at) AS last_seen FROM access_log GROUP BY 1",
    "space_items_page": dom.prelude("memory_index") + """, r AS (SELECT * FROM memory_index WHERE user_id = 7 AND list_contains(space_ids, 'en')), c AS (SELECT created_at AS t, memory_id AS m FROM r WHERE memory_id = 157)
  SELECT memory_id, created_at FROM r, c WHERE created_at < t OR (created_at = t AND memory_id > m) ORDER BY created_at DESC, memory_id LIMIT 20""",
    "other_spaces": dom.prelude("memory_index", "memory_space") + """, x AS (SELECT memory_id, unnest(space_ids) AS sid, unnest(range(len(space_ids))) AS pos FROM memory_index WHERE list_contains(space_ids, 'en'))
  SELECT memory_id, string_agg(name, ',' ORDER BY pos) AS others FROM x JOIN memory_space ON id = sid WHERE sid <> 'en' GROUP BY 1""",
    "latest_code": f"""SELECT user_id AS key, event_id AS id FROM events WHERE event_id % 3 <> 0 AND ts + INTERVAL 10 DAY > TIMESTAMP '{dom.AS_OF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "token_resolution": dom.prelude("connection", "grants") + """ SELECT c.c_custkey AS request_id, x.id AS connection_id, x.user_id, coalesce(g, '') AS granted FROM customer c JOIN connection x ON x.label = c.c_name AND NOT x.revoked
  LEFT JOIN (SELECT connection_id, string_agg(space_id, ',' ORDER BY space_id) AS g FROM grants GROUP BY 1) gg ON gg.connection_id = x.id""",
    "grants_after_changes": dom.prelude("grants") + " SELECT * FROM (SELECT connection_id, space_id FROM grants UNION SELECT c_custkey, '3' FROM customer WHERE c_nationkey = 3) WHERE space_id <> '13'",
    "revoke_connections": dom.prelude("connection") + " SELECT id, revoked OR id % 8 = 4 AS revoked FROM connection",
    "accepted_files": dom.prelude("files") + " SELECT id, id % 3 <> 1 AND size_bytes > 0 AND size_bytes <= 20971520 AS accepted FROM files",
    "lookup_document": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42",
    "first_match": "SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 1",
    "health": "SELECT bool_and(r_regionkey >= 0) AS ok, CASE WHEN bool_and(r_regionkey >= 0) THEN 'ok' ELSE 'degraded' END AS status FROM region",
}
