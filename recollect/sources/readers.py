"""Sources: parquet tables, text files by type, chat exports, event-stream lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import parsed_json
from ..schemas import MAX_FILE_BYTES, MIME_DOCX, MIME_PDF, MIME_TEXT, schema

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key."""
    return df.where(F.col(key) == F.lit(value))


def first_match(df: DataFrame, *order: str, **equal) -> DataFrame:
    """At most one row that fits all conditions, the first in the given order."""
    for k, v in equal.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.orderBy(*order).limit(1) if order else df.limit(1)


def accepted_file(mime: Column, size: Column) -> Column:
    return F.coalesce(mime.isin(*MIME_TEXT, MIME_PDF, MIME_DOCX) & (size > 0) & (size <= MAX_FILE_BYTES), F.lit(False))


def _pages(content: bytes, mime: str) -> str:
    import io

    if mime == MIME_PDF:
        import pypdf

        return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)
    import docx

    return "\n".join(p.text for p in docx.Document(io.BytesIO(content)).paragraphs)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _document_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, mimes in batches:
        out = []
        for content, mime in zip(contents, mimes, strict=True):
            try:
                out.append((None if content is None else _pages(content, mime), None))
            except Exception as e:  # whatever a file breaks is that file's error
                out.append((None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["text", "error"])


def parsed(content: Column, mime: Column) -> Column:
    """(text, error) of a file's bytes by type. CSV and JSON are text, not tables; an unknown type and a broken file are errors."""
    made = _document_text(F.when(mime.isin(MIME_PDF, MIME_DOCX), content), mime)
    plain = F.make_valid_utf8(content.cast("string"))
    unknown = F.concat(F.lit("unsupported type: "), F.coalesce(mime, F.lit("null")))
    none = F.lit(None).cast("string")
    return F.when(mime.isin(*MIME_TEXT), F.struct(plain.alias("text"), none.alias("error"))).when(mime.isin(MIME_PDF, MIME_DOCX), made).otherwise(F.struct(none.alias("text"), unknown.alias("error")))


def parsed_text(content: Column, mime: Column) -> Column:
    """Text of a file's bytes; what ``parsed`` calls an error stops the query."""
    p = parsed(content, mime)
    return F.when(p["error"].isNotNull(), F.raise_error(p["error"])).otherwise(p["text"])


MIME_BY_EXTENSION = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "pdf": MIME_PDF, "docx": MIME_DOCX}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, mime_type, text) of the files below a path."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    mime = F.create_map(*[F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv])[ext]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), mime.alias("mime_type"), "content").select("path", "size_bytes", "mime_type", parsed_text(F.col("content"), F.col("mime_type")).alias("text"))


def content_or_placeholder(text: Column, name: Column) -> Column:
    """A missing object stands as a line naming the file."""
    return F.coalesce(text, F.concat(F.lit("[file: "), name, F.lit("]")))


def pasted(spark: SparkSession, user_id: str, text: str) -> DataFrame:
    return spark.createDataFrame([(user_id, text, "chat_import")], "user_id string, text string, source string")


def chat_export(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(title, nodes) of each conversation of raw export texts, nodes in the order of the mapping.

    A text that is not a JSON array of conversations is an error.
    """
    ddl = schema("chat_export")["c"].dataType.simpleString()
    convs = F.coalesce(parsed_json(F.col(raw_col), ddl), F.raise_error(F.lit("not a JSON array of conversations")).cast(ddl))
    checked = F.when(F.trim(F.col(raw_col)).startswith("["), convs).otherwise(F.raise_error(F.lit("not a JSON array of conversations")).cast(ddl))
    return raw.select(F.explode(checked).alias("c")).select("c.title", F.map_values("c.mapping").alias("nodes"))


def as_event_lines(events: DataFrame, *columns: str) -> DataFrame:
    """Events as ``data: {json}`` lines, each followed by a blank line. Columns that are not among the named ones (default: all) stay beside."""
    inside = columns or tuple(events.columns)
    return events.select(*[c for c in events.columns if c not in inside], F.concat(F.lit("data: "), F.to_json(F.struct(*inside)), F.lit("\n\n")).alias("value"))


def event_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse ``data: {json}`` lines of an event stream; other lines are dropped."""
    text = F.regexp_extract(F.col(col), r"(?s)^data: (.*?)\s*$", 1)
    return lines.where(F.col(col).startswith("data: ")).select(F.from_json(text, schema("stream_event")).alias("e")).where("e IS NOT NULL").select("e.*")


def event_parts(raw: DataFrame, *keep: str, col: str = "value") -> DataFrame:
    """Events of raw stream texts: parts end at a blank line, what follows the last one is not whole yet and is dropped."""
    parts = F.split(F.col(col), "\n\n")
    lines = raw.select(*keep, F.explode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("_line")).where(F.col("_line").startswith("data: "))
    return lines.select(*keep, F.from_json(F.substring("_line", 7, 2**31 - 1), schema("stream_event")).alias("e")).where("e IS NOT NULL").select(*keep, "e.*")


def sql_with(spark: SparkSession, text: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """SQL over named tables ``{name}`` with parameters ``:name``, whose values never become part of the text."""
    return spark.sql(text, args=values, **tables)
