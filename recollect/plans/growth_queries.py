"""Growth, areas and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import moment
from ..operators import growth as g
from ..sources import domain as dom


def now():
    return moment(dom.AS_OF)


def _series(s, d, span="week"):
    return g.growth_series(dom.growth_events(s, d), dom.named_spaces(s), now(), span)


def _areas(s, d):
    return g.areas(dom.memory_index(s, d), dom.memory_spaces(s))


QUERIES = {
    "growth_series": lambda s, d: g.in_order(_series(s, d)),
    "growth_series_hourly": lambda s, d: g.in_order(_series(s, d, "day")),
    "growth_totals": lambda s, d: g.growth_totals(dom.growth_events(s, d), now()),
    "growth_chart_rollup": lambda s, d: g.in_order(g.chart_rollup(_series(s, d))),
    "growth_stack_offsets": lambda s, d: g.stack_offsets(_series(s, d)),
    "areas": _areas,
    "space_counts": lambda s, d: g.space_counts(dom.memory_index(s, d), dom.memory_spaces(s)),
    "relative_sizes": lambda s, d: g.relative_sizes(_areas(s, d)),
    "areas_total": lambda s, d: _areas(s, d).agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("used")),
}


def _series_sql(width: str, days: int) -> str:
    return f"""series AS (SELECT strftime(b, '%Y-%m-%dT%H:%M:%S.%gZ') AS bucket, coalesce(space_id, '') AS space_id,
  CASE WHEN space_id IS NULL THEN 'Sin clasificar' ELSE coalesce(name, space_id) END AS space_name, n AS count
  FROM (SELECT date_trunc('{width}', created_at) AS b, space_id, count(*) AS n FROM growth_event WHERE created_at >= TIMESTAMP '{dom.AS_OF}' - INTERVAL {days} DAY GROUP BY 1, 2) LEFT JOIN named_space ON id = space_id)"""


_GROWTH = dom.prelude("growth_event", "named_space") + ",\n"
_WEEK = _GROWTH + _series_sql("day", 7)
_AREAS = dom.prelude("memory_index", "memory_space") + """,
n AS (SELECT x AS id, count(*) AS n FROM (SELECT unnest(space_ids) AS x FROM memory_index) GROUP BY 1),
areas AS (SELECT id, name, coalesce(n, 0) AS count, CAST(floor(100.0::DOUBLE * coalesce(n, 0) / greatest((SELECT coalesce(sum(n), 0) FROM n), 1) + 0.5) AS INTEGER) AS percentage FROM memory_space LEFT JOIN n USING (id))
"""
ORACLE_SQL = {
    "growth_series": _WEEK + " SELECT * FROM series",
    "growth_series_hourly": _GROWTH + _series_sql("hour", 1) + " SELECT * FROM series",
    "growth_totals": dom.prelude("growth_event") + f""" SELECT today, week, previous_week, week - previous_week AS delta FROM (SELECT count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{dom.AS_OF}')) AS today,
  count(*) FILTER (created_at >= TIMESTAMP '{dom.AS_OF}' - INTERVAL 7 DAY) AS week, count(*) FILTER (created_at >= TIMESTAMP '{dom.AS_OF}' - INTERVAL 14 DAY AND created_at < TIMESTAMP '{dom.AS_OF}' - INTERVAL 7 DAY) AS previous_week FROM growth_event)""",
    "growth_chart_rollup": _WEEK + """, t AS (SELECT bucket, CAST(sum(count) AS BIGINT) AS total FROM series GROUP BY 1)
 SELECT bucket, total, CAST(greatest(2, floor(total::DOUBLE / (SELECT greatest(max(total), 1) FROM t) * 120 + 0.5)) AS INTEGER) AS height FROM t""",
    "growth_stack_offsets": _WEEK + """, t AS (SELECT bucket, sum(count) AS total FROM series GROUP BY 1),
 h AS (SELECT bucket, space_id, CAST(floor(count::DOUBLE / (SELECT greatest(max(total), 1) FROM t) * 120 + 0.5) AS INTEGER) AS h FROM series)
 SELECT bucket, space_id, h, CAST(120 - sum(h) OVER (PARTITION BY bucket ORDER BY space_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS y FROM h""",
    "areas": _AREAS + " SELECT * FROM areas",
    "space_counts": _AREAS + " SELECT id, name, count FROM areas",
    "relative_sizes": _AREAS + """ SELECT id, count, greatest(0.5::DOUBLE, count::DOUBLE / top) AS size, CAST(floor(80 + greatest(0.5::DOUBLE, count::DOUBLE / top) * 80 + 0.5) AS INTEGER) AS height,
  CAST((row_number() OVER (ORDER BY count DESC, id) - 1) % 8 AS INTEGER) AS color FROM areas, (SELECT greatest(max(count), 1) AS top FROM areas)""",
    "areas_total": _AREAS + " SELECT CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS used FROM areas",
}
