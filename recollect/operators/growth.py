"""Growth analytics: label counts with shares, bucketed series, period totals, chart geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.text import round_half_up
from ..functions.times import bucket, days_before, iso

UNLABELLED = "Sin clasificar"
CHART_HEIGHT, CARD_MIN, CARD_MAX, PALETTE_SIZE = 120, 80, 160, 8


def space_counts(memories: DataFrame, spaces: DataFrame) -> DataFrame:
    """(id, name, count): memberships of each existing label, zero included."""
    counts = memories.select(F.explode("space_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return spaces.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("count"))


def areas(memories: DataFrame, spaces: DataFrame) -> DataFrame:
    """(id, name, count, percentage) by count descending. The total is of all memberships, deleted labels' too."""
    counts = memories.select(F.explode("space_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))  # one row
    rows = spaces.join(counts, "id", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return rows.select("id", "name", n.alias("count"), round_half_up(100.0 * n / F.col("total")).cast("int").alias("percentage")).orderBy(F.desc("count"), "id")


def relative_sizes(areas: DataFrame) -> DataFrame:
    """Card size and height relative to the largest count, and the palette place by rank; among an owner's labels where ``areas`` has a ``user_id``."""
    owner = [c for c in ("user_id",) if c in areas.columns]
    count = F.coalesce("count", F.lit(0))
    top = F.greatest(F.max(count).over(Window.partitionBy(*owner)), F.lit(1))
    size = F.greatest(F.lit(0.5), F.col("count") / top)
    rank = F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("count"), "id"))  # without owners one row a label of one owner
    return areas.select(*owner, "id", "count", size.alias("size"), round_half_up(CARD_MIN + size * (CARD_MAX - CARD_MIN)).cast("int").alias("height"), ((rank - 1) % PALETTE_SIZE).alias("color"))


def since(as_of: Column, span: str) -> tuple[Column, str]:
    """Lower bound and bucket width; any span but 'day' is a week."""
    return (days_before(as_of, 1), "hour") if span == "day" else (days_before(as_of, 7), "day")


def growth_series(events: DataFrame, spaces: DataFrame, as_of: Column, span: str = "week", user_id=None) -> DataFrame:
    """(bucket, space_id, space_name, count) per bucket and label; no gap filling, unlabelled events are a group."""
    start, width = since(as_of, span)
    if user_id is not None:
        events = events.where(F.col("user_id") == F.lit(user_id))
    counts = events.where(F.col("created_at") >= start).groupBy(bucket(width, F.col("created_at")).alias("b"), "space_id").agg(F.count("*").alias("count"))
    named = counts.join(small(spaces.select(F.col("id").alias("space_id"), "name")), "space_id", "left")
    name = F.when(F.col("space_id").isNull(), UNLABELLED).otherwise(F.coalesce("name", "space_id"))
    return named.select(iso(F.col("b")).alias("bucket"), F.coalesce("space_id", F.lit("")).alias("space_id"), name.alias("space_name"), "count")


def growth_totals(events: DataFrame, as_of: Column) -> DataFrame:
    """(today, week, previous_week, delta) in one pass; today starts at midnight, weeks roll."""
    t = F.col("created_at")
    week, before = days_before(as_of, 7), days_before(as_of, 14)
    counts = events.where(t >= before).agg(F.count_if(t >= F.date_trunc("day", as_of).cast("timestamp_ntz")).alias("today"), F.count_if(t >= week).alias("week"), F.count_if((t >= before) & (t < week)).alias("previous_week"))
    return counts.withColumn("delta", F.col("week") - F.col("previous_week"))


def chart_rollup(series: DataFrame) -> DataFrame:
    """(bucket, total, height): bars relative to the highest bucket, at least two points high."""
    totals = series.groupBy("bucket").agg(F.sum("count").alias("total"))
    top = totals.agg(F.greatest(F.max("total"), F.lit(1)).alias("top"))
    return totals.crossJoin(F.broadcast(top)).select("bucket", "total", F.greatest(F.lit(2), round_half_up(F.col("total") / F.col("top") * CHART_HEIGHT)).cast("int").alias("height"))


def stack_offsets(series: DataFrame) -> DataFrame:
    """(bucket, space_id, h, y): segments stacked from the bottom, in label order."""
    top = series.groupBy("bucket").agg(F.sum("count").alias("t")).agg(F.greatest(F.max("t"), F.lit(1)).alias("top"))
    h = round_half_up(F.col("count") / F.col("top") * CHART_HEIGHT).cast("int")
    below = Window.partitionBy("bucket").orderBy("space_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.crossJoin(F.broadcast(top)).select("bucket", "space_id", h.alias("h")).select("bucket", "space_id", "h", (F.lit(CHART_HEIGHT) - F.sum("h").over(below)).alias("y"))


def in_order(series: DataFrame) -> DataFrame:
    """A series or roll-up by bucket, then by label where it has labels. Buckets are ISO strings, so this is by time."""
    return series.orderBy("bucket", *[c for c in ("space_id",) if c in series.columns])
