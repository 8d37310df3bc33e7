"""Membership maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import clamp, confirmed, toggle
from ..functions.times import moment
from ..operators import ingest as ing
from ..operators import membership as m
from ..sources import domain as dom
from ..sources.readers import load


def now():
    return moment(dom.AS_OF)


def _new_labels(s, d):
    """Every third document gets 'long', then 'extra'."""
    return load(s, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("memory_id"), F.array(F.lit("long"), F.lit("extra")).alias("space_ids"))


def _versions(s):
    return s.createDataFrame([("en", 3), ("de", 2), ("long", 2), ("extra", 5)], "space_id string, version int")


def flat(df):
    entries = F.transform(F.array_sort(F.map_entries("space_versions")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return df.select("memory_id", F.array_join("space_ids", ",").alias("space_ids"), F.array_join(entries, ",").alias("versions"), "manual_override")


def _applied(s, d, backfill=False):
    return m.apply_labels(dom.memory_index(s, d), _new_labels(s, d), _versions(s), backfill)


def _edits(s, d):
    e = load(s, d, "documents").where("doc_id % 5 = 0")
    return e.select(F.col("doc_id").alias("memory_id"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("picked").alias("space_id"), (F.col("doc_id") % 2 == 1).alias("add"), F.lit(9).alias("version"))


def _doomed(s, d):
    return dom.files(s, d).where("id % 4 = 0").select(F.col("id").alias("file_id"), (F.col("id") % 50).alias("user_id"))


def _cascade(s, d, part):
    return m.cascade_delete(_doomed(s, d), dom.memory_index(s, d), dom.growth_events(s, d))[part]


def _bumped(s, d):
    """Customers as labels, all of them edited: descriptions stay, are given again or change, every second name changes."""
    c, n = load(s, d, "customer"), F.col("c_custkey")
    spaces = c.select(n.cast("string").alias("space_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), (F.col("c_nationkey") % 4 + 1).alias("version"), (F.col("c_acctbal") < 0).alias("reclassifying"))
    described = F.when(n % 3 == 1, F.col("c_mktsegment")).when(n % 3 == 2, F.concat("c_mktsegment", F.lit(" texts")))
    return m.bump_versions(spaces, c.select(n.cast("string").alias("space_id"), described.alias("description"), F.when(n % 2 == 0, F.upper("c_name")).alias("name")))


def _insert_ignore(s, d):
    docs = load(s, d, "documents").select("doc_id", "lang")
    new = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", -F.col("doc_id")))
    return m.insert_ignore(docs.where("doc_id >= 0"), new, "doc_id").select("doc_id")


def _upsert(s, d):
    base = load(s, d, "nation").select("n_nationkey", "n_name")
    delta = base.where("n_nationkey >= 20").select((F.col("n_nationkey") + 3).alias("n_nationkey"), F.lower("n_name").alias("n_name"))
    return m.upsert(base, delta, "n_nationkey")


QUERIES = {
    "apply_labels": lambda s, d: flat(_applied(s, d)),
    "manual_override_guard": lambda s, d: flat(_applied(s, d, True)),
    "stamp_growth": lambda s, d: m.stamp_growth(dom.growth_events(s, d), _new_labels(s, d)).select("id", "space_id"),
    "remove_label": lambda s, d: flat(m.remove_label(dom.memory_index(s, d), "en")),
    "delete_space_grants": lambda s, d: m.delete_space(dom.vector_spaces(s, d).withColumn("space_id", F.col("space_id").cast("string")), dom.grants(s, d), dom.memory_index(s, d), "3")[1],
    "manual_edits": lambda s, d: flat(m.set_manually(dom.memory_index(s, d), _edits(s, d))),
    "stale_memberships": lambda s, d: m.stale(dom.memory_index(s, d), _versions(s)),
    "cascade_delete": lambda s, d: _cascade(s, d, 0).select("memory_id", "file_id"),
    "cascade_delete_growth": lambda s, d: _cascade(s, d, 1).select("id", "memory_id"),
    "insert_ignore": _insert_ignore,
    "upsert": _upsert,
    "bump_versions": _bumped,
    "toggle_membership": lambda s, d: dom.memory_index(s, d).select("memory_id", F.array_join(toggle(F.col("space_ids"), F.lit("long")), ",").alias("space_ids")),
    "clamp_sets": lambda s, d: dom.memory_index(s, d).select("memory_id", F.array_join(clamp(F.when(F.col("memory_id") % 4 != 0, F.array(F.lit("fr"), F.lit("long"), F.lit("en"), F.lit("fr"))), F.col("space_ids")), ",").alias("effective")),
    "confirmed_candidates": lambda s, d: dom.memory_index(s, d).select("memory_id", F.array_join(confirmed(F.col("space_ids"), F.lit("long , en")), ",").alias("confirmed")),
    "growth_of_new_items": lambda s, d: ing.growth_of(dom.memory_index(s, d).select("memory_id", "user_id"), load(s, d, "labels").select(F.col("doc_id").alias("memory_id")), now()).select("id", "user_id", "created_at"),
    "job_status": lambda s, d: ing.job_status(load(s, d, "pages").select(F.col("page_id").alias("file_id"), F.when(F.col("page_id") % 3 == 0, F.col("html")).alias("error"), (F.col("page_id") % 4).alias("attempts"))),
}

_MI = dom.prelude("memory_index")
_VER = "ver(space_id, version) AS (VALUES ('en', 3), ('de', 2), ('long', 2), ('extra', 5))"


def _flat_sql(ids: str, versions: str, manual: str = "manual_override") -> str:
    """ids: list of the ids; versions: list of 'id:version' texts."""
    return f"SELECT memory_id, array_to_string({ids}, ',') AS space_ids, array_to_string(list_sort({versions}), ',') AS versions, {manual} AS manual_override FROM memory_index"


def _put(hit: str, new: str, values: str) -> str:
    ids = f"CASE WHEN {hit} THEN list_concat(space_ids, list_filter({new}, lambda x: NOT list_contains(space_ids, x))) ELSE space_ids END"
    own = "list_transform(space_ids, lambda x: x || ':' || v)"
    vers = f"CASE WHEN {hit} THEN list_concat(list_transform(list_filter(space_ids, lambda x: NOT list_contains({new}, x)), lambda x: x || ':' || v), {values}) ELSE {own} END"
    return _flat_sql(ids, vers)


_DROP = "list_filter(space_ids, lambda x: x <> 'en')"
ORACLE_SQL = {
    "apply_labels": _MI + " " + _put("memory_id % 3 = 0", "['long', 'extra']", "['long:2', 'extra:5']"),
    "manual_override_guard": _MI + " " + _put("memory_id % 3 = 0 AND NOT manual_override", "['long', 'extra']", "['long:2', 'extra:5']"),
    "stamp_growth": dom.prelude("growth_event") + " SELECT g.id, coalesce(space_id, CASE WHEN doc_id IS NOT NULL THEN 'long' END) AS space_id FROM growth_event g LEFT JOIN documents ON doc_id = memory_id AND doc_id % 3 = 0",
    "remove_label": _MI + " " + _flat_sql(_DROP, f"list_transform({_DROP}, lambda x: x || ':' || v)"),
    "delete_space_grants": dom.prelude("grants") + " SELECT * FROM grants WHERE space_id <> '3'",
    "manual_edits": _MI + f""" SELECT memory_id, array_to_string(CASE WHEN memory_id % 10 = 0 THEN {_DROP} WHEN memory_id % 5 = 0 THEN list_append(space_ids, 'picked') ELSE space_ids END, ',') AS space_ids,
 array_to_string(list_sort(CASE WHEN memory_id % 10 = 0 THEN list_transform({_DROP}, lambda x: x || ':' || v) WHEN memory_id % 5 = 0 THEN list_append(list_transform(space_ids, lambda x: x || ':' || v), 'picked:9') ELSE list_transform(space_ids, lambda x: x || ':' || v) END), ',') AS versions,
 manual_override OR memory_id % 5 = 0 AS manual_override FROM memory_index""",
    "stale_memberships": _MI + f", {_VER}, h AS (SELECT memory_id, unnest(space_ids) AS space_id, v AS version FROM memory_index) SELECT memory_id, h.space_id, h.version, ver.version AS current FROM h JOIN ver USING (space_id) WHERE h.version < ver.version",
    "cascade_delete": dom.prelude("memory_index", "files") + ", x AS (SELECT id AS file_id, id % 50 AS user_id FROM files WHERE id % 4 = 0) SELECT memory_id, file_id FROM memory_index WHERE (file_id, user_id) NOT IN (SELECT file_id, user_id FROM x)",
    "cascade_delete_growth": dom.prelude("memory_index", "files", "growth_event") + ", x AS (SELECT id AS file_id, id % 50 AS user_id FROM files WHERE id % 4 = 0), g AS (SELECT memory_id FROM memory_index WHERE (file_id, user_id) IN (SELECT file_id, user_id FROM x)) SELECT id, memory_id AS memory_id FROM growth_event WHERE memory_id NOT IN (SELECT memory_id FROM g)",
    "insert_ignore": "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT -doc_id FROM documents WHERE doc_id % 3 = 0) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id >= 0)",
    "upsert": "WITH b AS (SELECT n_nationkey, n_name FROM nation), d AS (SELECT n_nationkey + 3 AS k, lower(n_name) AS m FROM nation WHERE n_nationkey >= 20) SELECT CAST(coalesce(k, n_nationkey) AS INTEGER) AS n_nationkey, coalesce(m, n_name) AS n_name FROM b FULL JOIN d ON n_nationkey = k",
    "bump_versions": """SELECT CAST(c_custkey AS VARCHAR) AS space_id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, c_mktsegment || CASE WHEN c_custkey % 3 = 2 THEN ' texts' ELSE '' END AS description,
  CAST(c_nationkey % 4 + 1 + CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS version, c_acctbal < 0 OR c_custkey % 3 = 2 AS reclassifying FROM customer""",
    "toggle_membership": _MI + " SELECT memory_id, array_to_string(CASE WHEN list_contains(space_ids, 'long') THEN list_filter(space_ids, lambda x: x <> 'long') ELSE list_append(space_ids, 'long') END, ',') AS space_ids FROM memory_index",
    "clamp_sets": _MI + " SELECT memory_id, array_to_string(CASE WHEN memory_id % 4 = 0 THEN space_ids ELSE list_filter(['fr', 'long', 'en', 'fr'], lambda x: list_contains(space_ids, x)) END, ',') AS effective FROM memory_index",
    "confirmed_candidates": _MI + " SELECT memory_id, array_to_string(list_filter(space_ids, lambda x: x IN ('long', 'en')), ',') AS confirmed FROM memory_index",
    "growth_of_new_items": _MI + f" SELECT memory_id AS id, user_id, TIMESTAMP '{dom.AS_OF}' AS created_at FROM memory_index WHERE memory_id NOT IN (SELECT doc_id FROM labels)",
    "job_status": "SELECT page_id AS file_id, CASE WHEN page_id % 3 <> 0 THEN 'indexed' WHEN page_id % 4 >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN page_id % 3 = 0 THEN substr(html, 1, 500) END AS error FROM pages",
}
