"""A small seed of invented personas, each with verbatim memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import schema

SEED = [
    (f"p{i}", name, role, company, [f"{name} works as {role}", f"{name} works at {company}", f"{name} prefers {liked}", f"{name} is learning {learning}", f"{name} meets the team on {day}", f"{name} keeps notes about {topic}"])
    for i, (name, role, company, liked, learning, day, topic) in enumerate(
        [
            ("Ada", "engineer", "Northwind", "short reports", "Scala", "Monday", "query plans"),
            ("Bruno", "designer", "Contoso", "paper sketches", "motion design", "Tuesday", "type faces"),
            ("Chen", "analyst", "Fabrikam", "dashboards", "statistics", "Wednesday", "retention"),
            ("Dalia", "founder", "Tailspin", "phone calls", "finance", "Thursday", "fundraising"),
            ("Emil", "teacher", "Lucerne", "field trips", "Spanish", "Friday", "lesson plans"),
            ("Farah", "nurse", "Woodgrove", "checklists", "first aid", "Saturday", "night shifts"),
        ]
    )
]


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED, schema("persona"))
