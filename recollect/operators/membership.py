"""Maintenance of label memberships on immutable tables: every operation returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import drop_key, put, put_all, remove, union
from ..functions.joins import small


def apply_labels(memories: DataFrame, new: DataFrame, versions: DataFrame | None = None, is_backfill: bool = False) -> DataFrame:
    """Add labels: new (memory_id, space_ids in order). Existing ids come first; a backfill leaves manual rows alone.

    versions: (space_id, version) of the labels, 1 where there is none. Several deltas of an item are joined first.
    """
    pairs = new.select("memory_id", F.posexplode("space_ids").alias("pos", "space_id"))
    if versions is not None:
        pairs = pairs.join(small(versions), "space_id", "left")
    version = F.coalesce("version", F.lit(1)) if versions is not None else F.lit(1)
    per = pairs.select("memory_id", "pos", "space_id", version.cast("int").alias("version")).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("pos", "space_id", "version"))).alias("x"))
    ids = F.array_distinct(F.transform("x", lambda e: e["space_id"]))
    latest = F.map_from_arrays(ids, F.transform(ids, lambda i: F.array_max(F.transform(F.filter("x", lambda e: e["space_id"] == i), lambda e: e["version"]))))
    rows = memories.join(per.select("memory_id", ids.alias("_ids"), latest.alias("_versions")), "memory_id", "left")
    hit = F.col("_ids").isNotNull() & (~F.col("manual_override") if is_backfill else F.lit(True))
    return rows.withColumns({"space_ids": F.when(hit, union(F.col("space_ids"), F.col("_ids"))).otherwise(F.col("space_ids")), "space_versions": F.when(hit, put_all(F.col("space_versions"), F.col("_versions"))).otherwise(F.col("space_versions"))}).drop("_ids", "_versions").select(*memories.columns)


def stamp_growth(events: DataFrame, new: DataFrame) -> DataFrame:
    """Give unlabelled growth events the first label their item has just got."""
    first = new.where(F.size("space_ids") > 0).select("memory_id", F.element_at("space_ids", 1).alias("_first")).dropDuplicates(["memory_id"])
    return events.join(first, "memory_id", "left").withColumn("space_id", F.coalesce("space_id", "_first")).drop("_first").select(*events.columns)


def remove_label(memories: DataFrame, space_id: str) -> DataFrame:
    """Take a label off every item."""
    has = F.coalesce(F.array_contains("space_ids", space_id), F.lit(False))
    x = F.lit(space_id)
    return memories.withColumns({"space_versions": F.when(has, drop_key(F.col("space_versions"), x)).otherwise(F.col("space_versions")), "space_ids": F.when(has, remove(F.col("space_ids"), x)).otherwise(F.col("space_ids"))})


def delete_space(spaces: DataFrame, grants: DataFrame, memories: DataFrame, space_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spaces, grants, memories) without a label."""
    return spaces.where(F.col("space_id") != space_id), grants.where(F.col("space_id") != space_id), remove_label(memories, space_id)


def set_manually(memories: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits (memory_id, space_id, add boolean, version), one a row of an item: the row is marked as manual."""
    rows = memories.join(edits.withColumnsRenamed({"space_id": "_space", "version": "_version"}), "memory_id", "left")
    add, sid = F.coalesce("add", F.lit(False)), F.col("_space")
    hit = sid.isNotNull()
    return rows.withColumns({
        "space_versions": F.when(hit & add, put(F.col("space_versions"), sid, F.col("_version"))).when(hit, drop_key(F.col("space_versions"), sid)).otherwise(F.col("space_versions")),
        "space_ids": F.when(hit & add, union(F.col("space_ids"), F.array(sid))).when(hit, remove(F.col("space_ids"), sid)).otherwise(F.col("space_ids")),
        "manual_override": F.col("manual_override") | hit,
    }).select(*memories.columns)


def stale(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """(memory_id, space_id, version, current) of memberships classified under an older version of the label."""
    have = memories.select("memory_id", F.explode("space_versions").alias("space_id", "version"))
    return have.join(small(versions.withColumnRenamed("version", "current")), "space_id").where("version < current").select("memory_id", "space_id", "version", "current")


def cascade_delete(files: DataFrame, memories: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, growth events) without the items of the given files (file_id, user_id); owners must fit."""
    gone = memories.join(files, ["file_id", "user_id"], "left_semi").select("memory_id")
    return memories.join(files, ["file_id", "user_id"], "left_anti").select(*memories.columns), events.join(gone, "memory_id", "left_anti").select(*events.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows of ``new`` that an insert adds: one a key, none whose key is there."""
    keys = [key] if isinstance(key, str) else key
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of base with the delta's non-null values, and the delta's new rows. delta: one row a key."""
    b, d = base.alias("b"), delta.alias("d")
    cols = [F.coalesce(f"d.{c}", f"b.{c}").alias(c) if c in delta.columns else F.col(f"b.{c}") for c in base.columns]
    return b.join(d, F.col(f"b.{key}") == F.col(f"d.{key}"), "full").select(*cols)


def update(base: DataFrame, delta: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of base where those that the delta names (one row a key) take its values of the named columns, nulls too; other keys add nothing."""
    new = delta.select(F.col(key), F.struct(*columns).alias("_new"))
    rows = base.join(new, key, "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def bump_versions(spaces: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (space_id, description, name; null: no change): a changed description raises the version and starts a reclassification."""
    rows = spaces.join(edits.select("space_id", F.col("description").alias("_d"), F.col("name").alias("_n")), "space_id", "left")
    changed = F.col("_d").isNotNull() & ~F.col("_d").eqNullSafe(F.col("description"))
    return rows.withColumns({"version": F.col("version") + changed.cast("int"), "reclassifying": F.col("reclassifying") | changed, "name": F.coalesce("_n", "name"), "description": F.coalesce("_d", "description")}).select(*spaces.columns)


def space_items_page(memories: DataFrame, space_id: str, user_id, cursor=None, limit: int = 20) -> DataFrame:
    """An owner's items of a label, newest first, after the item ``cursor``."""
    rows = memories.where((F.col("user_id") == F.lit(user_id)) & F.array_contains("space_ids", space_id))
    if cursor is not None:
        at = rows.where(F.col("memory_id") == F.lit(cursor)).agg(F.min(F.struct("created_at", "memory_id")).alias("_c")).select(F.col("_c.created_at").alias("_t"), F.col("_c.memory_id").alias("_m"))
        rows = rows.crossJoin(F.broadcast(at)).where((F.col("created_at") < F.col("_t")) | ((F.col("created_at") == F.col("_t")) & (F.col("memory_id") > F.col("_m")))).drop("_t", "_m")  # one row
    return rows.orderBy(F.desc("created_at"), "memory_id").limit(limit)


def other_spaces(memories: DataFrame, spaces: DataFrame, space_id: str) -> DataFrame:
    """(memory_id, others): names of an item's other existing labels, in the item's order."""
    rows = memories.where(F.array_contains("space_ids", space_id)).select("memory_id", F.posexplode("space_ids").alias("pos", "id")).where(F.col("id") != space_id)
    named = rows.join(small(spaces), "id")
    return named.groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",").alias("others"))
