"""Lead capture: validation, normalisation, attribution, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_of_list, normalize_email, strip, utm
from ..functions.times import iso
from ..schemas import EXPERIENCE, MONTHLY_SPEND, schema

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
SOURCE = "landing-v3"


def is_human(website: Column) -> Column:
    """The hidden field is blank."""
    return strip(F.coalesce(website, F.lit(""))) == ""


def is_valid(df: DataFrame) -> Column:
    ok = strip(F.col("email")).rlike(EMAIL) & (strip(F.col("role")) != "") & F.col("experience").isin(*EXPERIENCE) & (strip(F.col("ai_tools")) != "") & F.col("monthly_spend").isin(*MONTHLY_SPEND)
    return F.coalesce(ok, F.lit(False))


def normalized(posts: DataFrame, as_of: Column) -> DataFrame:
    """Accepted posts as lead rows plus their id, in the columns' fixed order."""
    good = posts.where(is_human(F.col("website")) & is_valid(posts))
    ref = F.coalesce("referer", F.lit(""))
    agent = F.coalesce("user_agent", F.lit("")) if "user_agent" in posts.columns else F.lit("")
    return good.select(
        "id", iso(as_of).alias("created_at"), normalize_email(F.col("email")).alias("email"), strip(F.col("role")).alias("role"), "experience", strip(F.col("ai_tools")).alias("ai_tools"), "monthly_spend",
        F.lit(SOURCE).alias("source"), ref.alias("referer"), agent.alias("user_agent"), first_of_list(F.col("accept_language")).alias("language"), *[utm(ref, f).alias(f) for f in ("utm_source", "utm_medium", "utm_campaign")],
    )


def deduplicated(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first row of each address that is not known yet."""
    fresh = rows if existing is None else rows.join(existing.select(normalize_email(F.col("email")).alias("email")).distinct(), "email", "left_anti")
    return fresh.groupBy("email").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "email"]), "id").alias("x")).select("x.*", "email").select(*rows.columns)


def append_sheet(rows: DataFrame, path: str) -> None:
    """Add the sheet's rows to those below a path, as CSV; what is there stays."""
    sheet_rows(rows).write.mode("append").option("header", True).csv(path)


def sheet_rows(rows: DataFrame) -> DataFrame:
    """The thirteen columns of the sheet, in order."""
    return rows.select(*schema("lead").fieldNames())
