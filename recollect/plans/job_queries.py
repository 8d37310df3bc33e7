"""Job, event-stream and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as j
from ..sources import domain as dom
from ..sources.readers import as_event_lines, event_parts, load, sql_with
from .membership_queries import flat
from .search_queries import HI, LO, SCORES
from .text_queries import fixed_sql, hits


def _backfilled(s, d, part):
    items = dom.items(s, d)
    ones = F.map_from_arrays("space_ids", F.transform("space_ids", lambda _: F.lit(1)))
    memories = items.select(F.col("id").alias("memory_id"), "space_ids", ones.alias("space_versions"), (F.col("id") % 11 == 0).alias("manual_override"))
    n = F.col("space_id") % 4
    spaces = dom.vector_spaces(s, d).withColumns({"version": (F.col("space_id") % 5 + 1).cast("int"), "reclassifying": n != 3})
    jobs = spaces.where(n != 3).select("space_id", F.when(n == 1, 3).otherwise(1).alias("attempts"), F.when(n != 0, "no answer").alias("error"))
    return j.backfill_job(memories, dom.growth_events(s, d), spaces, items, jobs, 200, HI, LO)[part]


def _attempt(s, d, part):
    """Pages by their url: every sixth is broken, half have been tried before, every other page has an old item."""
    p = load(s, d, "pages").withColumnRenamed("page_id", "file_id")
    n = F.col("file_id")
    files = p.select("file_id", F.col("url").alias("text"), F.when(n % 6 == 0, "broken").alias("error"))
    jobs = p.where(n % 3 == 0).select("file_id", (n % 50).alias("user_id"), F.lit("upload").alias("source"))
    old = p.where(n % 2 == 0).select(F.concat(F.lit("old"), "file_id").alias("memory_id"), "file_id", (n % 50).alias("user_id"), F.lit("upload").alias("source"), F.col("url").alias("text"))
    earlier = p.select("file_id", F.when((n % 4).isin(1, 2), "pending").otherwise("indexed").alias("status"), (n % 4).cast("int").alias("attempts"))
    return j.attempt(jobs, files, old, earlier)[part]


def _parts(s, d):
    """Two events of each turn and one that is cut off."""
    turns = load(s, d, "conversations").select("conv_id", F.col("role").alias("type"), F.col("text").alias("delta"))
    raw = as_event_lines(turns, "type", "delta").withColumn("value", F.concat("value", F.lit("event: ping\n\n"), "value", F.lit('data: {"type":"cut')))
    return event_parts(raw, "conv_id").select("conv_id", "type", "delta")


def _sessions(s, d):
    kind = F.col("event_type")
    a = F.when(kind == "signup", "plain_done").otherwise("plain_delta")
    b = F.when(kind == "purchase", "memory_done").when(kind == "view", "memory_tool_start").otherwise("memory_delta")
    even = F.col("event_id") % 2 == 0
    return load(s, d, "events").select(F.col("user_id").alias("session"), F.when(even, "a").otherwise("b").alias("stream"), F.col("event_id").alias("seq"), F.when(even, a).otherwise(b).alias("type"), F.concat(kind, F.col("event_id") % 3).alias("name"))


QUERIES = {
    "backfill_job": lambda s, d: flat(_backfilled(s, d, 0)),
    "backfill_job_growth": lambda s, d: _backfilled(s, d, 1).select("id", "space_id"),
    "backfill_job_spaces": lambda s, d: _backfilled(s, d, 2).select("space_id", "reclassifying"),
    "ingest_attempt": lambda s, d: _attempt(s, d, 0).select("memory_id", "file_id", "text"),
    "ingest_states": lambda s, d: _attempt(s, d, 1),
    "event_parts": _parts,
    "done_events": lambda s, d: j.done_events(_sessions(s, d)).select("session", "type", F.array_join("tool_calls", ",").alias("tool_calls")),
    "cached_reads": lambda s, d: j.cached_reads(hits(s, d), "key", "ts", "id", 86400),
    "sql_parameters": lambda s, d: sql_with(s, "SELECT space_id, count(*) AS n FROM {growth} WHERE created_at >= :since AND user_id % :parts = :part GROUP BY space_id", {"growth": dom.growth_events(s, d)}, since="2024-01-10", parts=3, part=1),
}

_GOT = SCORES + f""", near AS (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY score DESC, id) AS rank FROM bands),
got AS (SELECT id, space_id FROM near WHERE rank <= 200 AND (band = 'auto' OR band = 'candidate' AND score >= {(HI + LO) / 2}) AND space_id % 4 = 0 AND id % 11 <> 0)"""
_EVENT = "CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'signup' THEN 'plain_done' ELSE 'plain_delta' END WHEN event_type = 'purchase' THEN 'memory_done' WHEN event_type = 'view' THEN 'memory_tool_start' ELSE 'memory_delta' END"
ORACLE_SQL = {
    "backfill_job": _GOT + """, old AS (SELECT id, unnest(space_ids) AS k, unnest(range(len(space_ids))) AS p FROM items), lab AS (
  SELECT id, coalesce(o.k, g.k) AS k, coalesce(p, 1000 + g.n) AS p, coalesce(g.n % 5 + 1, 1) AS v FROM old o FULL JOIN (SELECT id, CAST(space_id AS VARCHAR) AS k, space_id AS n FROM got) g USING (id, k)),
 per AS (SELECT id, string_agg(k, ',' ORDER BY p) AS l, string_agg(k || ':' || v, ',' ORDER BY k) AS v FROM lab GROUP BY 1)
 SELECT id AS memory_id, coalesce(l, '') AS space_ids, coalesce(v, '') AS versions, id % 11 = 0 AS manual_override FROM items LEFT JOIN per USING (id)""",
    "backfill_job_growth": _GOT + f", {dom.SQL['growth_event']} SELECT e.id, coalesce(e.space_id, CAST(f.n AS VARCHAR)) AS space_id FROM growth_event e LEFT JOIN (SELECT id, min(space_id) AS n FROM got GROUP BY 1) f ON f.id = e.memory_id",
    "backfill_job_spaces": dom.prelude("vector_space") + " SELECT space_id, space_id % 4 = 2 AS reclassifying FROM vector_space",
    "ingest_attempt": "SELECT 'old' || page_id AS memory_id, page_id AS file_id, url AS text FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0 UNION ALL SELECT sha256(page_id || '|0|0|' || url), page_id, url FROM pages WHERE page_id % 3 = 0 AND page_id % 6 <> 0",
    "ingest_states": """WITH t AS (SELECT page_id, page_id % 6 = 0 AS bad, CASE WHEN page_id % 4 IN (1, 2) THEN page_id % 4 ELSE 0 END + 1 AS n FROM pages WHERE page_id % 3 = 0)
 SELECT page_id AS file_id, CASE WHEN NOT bad THEN 'indexed' WHEN n >= 3 THEN 'failed' ELSE 'pending' END AS status, CAST(n AS INTEGER) AS attempts, CASE WHEN bad THEN 'broken' END AS error FROM t""",
    "event_parts": "SELECT conv_id, role AS type, text AS delta FROM conversations, range(2)",
    "done_events": f"""WITH e AS (SELECT user_id AS session, event_id, {_EVENT} AS type, event_type || (event_id % 3) AS name FROM events)
 SELECT session, 'done' AS type, coalesce(string_agg(name, ',' ORDER BY event_id) FILTER (type = 'memory_tool_start'), '') AS tool_calls FROM e GROUP BY session HAVING bool_or(type = 'plain_done') AND bool_or(type = 'memory_done')""",
    "cached_reads": f"WITH RECURSIVE {fixed_sql('a', 'user_id')} SELECT id, key, no > 1 AS hit FROM a",
    "sql_parameters": dom.prelude("growth_event") + " SELECT space_id, count(*) AS n FROM growth_event WHERE created_at >= '2024-01-10' AND user_id % 3 = 1 GROUP BY 1",
}
