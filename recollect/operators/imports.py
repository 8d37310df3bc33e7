"""Conversation imports: chat exports and turn tables as one text a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.readers import chat_export

SHORTEST, LONGEST = 20, 8000
SAYS = {"user": "Usuario", "assistant": "IA"}


def said(role: Column) -> Column:
    return F.when(role == "user", SAYS["user"]).otherwise(SAYS["assistant"])


def _kept(df: DataFrame) -> DataFrame:
    return df.where(F.length("text") > SHORTEST).withColumn("text", F.substring("text", 1, LONGEST))


def from_export(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(title, text) of the conversations in raw export texts, in mapping order, with a header where there is a title."""
    text_of = lambda m: strip(F.array_join(F.filter(m["content"]["parts"], lambda p: p.isNotNull() & (p != "")), " "))
    said_by = lambda n: n["message"]["author"]["role"]
    spoken = F.filter("nodes", lambda n: F.coalesce(said_by(n).isin(*SAYS) & (n["message"]["content"]["content_type"] == "text"), F.lit(False)))
    lines = F.filter(F.transform(spoken, lambda n: F.struct(said_by(n).alias("role"), F.coalesce(text_of(n["message"]), F.lit("")).alias("t"))), lambda x: x["t"] != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(said(x["role"]), F.lit(": "), x["t"])), "\n")
    header = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit("["), F.col("title"), F.lit("]\n"))).otherwise("")
    return _kept(chat_export(raw, raw_col).select("title", F.when(F.size(lines) > 0, F.concat(header, body)).alias("text")))


def from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, text) of a table (conv_id, turn, role, text)."""
    t = strip(F.col("text"))
    lines = turns.where(F.col("role").isin(*SAYS) & (t != "")).select("conv_id", "turn", F.concat(said(F.col("role")), F.lit(": "), t).alias("line"))
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    return _kept(whole.select("conv_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text")))


def last_user_message(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_message"))


def merged_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two event streams as one, each tagged with its source; order inside a stream is kept by its own columns."""
    return a.withColumn("stream", F.lit("a")).unionByName(b.withColumn("stream", F.lit("b")))
