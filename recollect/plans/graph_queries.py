"""Entity graph and plug-in queries (stub extractors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm, normalize
from ..operators import graph as g
from ..operators import ingest as ing
from ..plugins import get
from ..sources import domain as dom
from ..sources.readers import load
from .text_queries import NORMAL, chunks_sql


def _graphs(s, d):
    return g.extracted(dom.memory_index(s, d).select("user_id", "text"))


def _facts(s, d):
    return ing.facts(ing.chunk(load(s, d, "documents").select("doc_id", "text"))).groupBy("doc_id").agg(F.count("*").alias("facts"))


def _embedded(s, d):
    v = load(s, d, "part").select("p_partkey", normalize(get("embed", "hashing")(F.col("p_name"))).alias("v"))
    return v.select("p_partkey", F.size("v").alias("dims"), F.round(norm(F.col("v")), 6).alias("norm"))


QUERIES = {
    "graph_vertices": lambda s, d: g.vertices(_graphs(s, d)),
    "graph_edges": lambda s, d: g.edges(_graphs(s, d)),
    "extract_facts": _facts,
    "embed_stub": _embedded,
    "infer_names": lambda s, d: load(s, d, "pages").select("page_id", get("name", "first_long_word")(F.col("url")).alias("name")),
}
_LONG = "list_filter(regexp_split_to_array(lower(text), '[^\\pL]+'), lambda w: length(w) >= 8)"
_WORDS = dom.prelude("memory_index") + f", w AS (SELECT user_id, memory_id, {_LONG} AS ws FROM memory_index WHERE text <> '')"
ORACLE_SQL = {
    "graph_vertices": _WORDS + " SELECT DISTINCT user_id, unnest(ws) AS id, unnest(ws) AS name, 'Topic' AS type FROM w",
    "graph_edges": _WORDS + ", p AS (SELECT user_id, unnest(ws[:-2]) AS source, unnest(ws[2:]) AS target FROM w WHERE len(ws) > 1) SELECT user_id, source, target, 'junto_a' AS label, count(*) AS weight FROM p GROUP BY ALL",
    "extract_facts": chunks_sql(f"norm AS (SELECT doc_id, {NORMAL} FROM documents)") + "SELECT doc_id, count(*) AS facts FROM chunked GROUP BY 1",
    "embed_stub": "SELECT p_partkey, CAST(64 AS INTEGER) AS dims, 1.0::DOUBLE AS norm FROM part",
    "infer_names": """WITH w AS (SELECT page_id, list_filter(regexp_split_to_array(url, '\\W+'), lambda x: length(x) >= 4) AS ws FROM pages)
 SELECT page_id, coalesce(substr(list_filter(ws, lambda x: length(x) = list_max(list_transform(ws, lambda y: length(y))))[1], 1, 50), 'Sin nombre') AS name FROM w""",
}
