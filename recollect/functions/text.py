"""Scalar text functions as Column builders."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

#: The white space that trimming removes.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

#: Where a JSON text goes that cannot be parsed.
BROKEN = "_broken"


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def normalize_text(c: Column) -> Column:
    """CRLF to LF, three or more newlines to two, trimmed."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))


def same_ignoring_case(a: Column, b: Column) -> Column:
    return normalize_email(a) == normalize_email(b)


def non_empty(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def split_trim(c: Column, sep: str = ",") -> Column:
    return F.transform(F.split(c, sep), strip)


def first_of_list(c: Column) -> Column:
    """First entry of a comma-separated header, '' where there is none."""
    return F.coalesce(strip(F.split_part(c, F.lit(","), F.lit(1))), F.lit(""))


def extension(name: Column) -> Column:
    """After the last dot; a name without a dot is its own extension; nothing gives 'bin'."""
    last = F.element_at(F.split(name, r"\."), -1)
    return F.when(last.isNull() | (last == ""), "bin").otherwise(last)


def ellipsis(c: Column, longest: int = 18, kept: int = 16) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, kept), F.lit("…"))).otherwise(c)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def format_bytes(n: Column) -> Column:
    kb, mb = n / 1024, n / (1024 * 1024)
    tenths = round_half_up(mb * 10)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(round_half_up(kb).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(" MB")))
    )


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def signed(c: Column) -> Column:
    return F.when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))


def query_mark(c: Column, size: int = 64) -> Column:
    """Start of the base64 form of a text, without line breaks."""
    return F.substring(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "\r\n", ""), 1, size)


def token_key(c: Column, size: int = 32) -> Column:
    """SHA-256 as url-safe base64 without padding, cut."""
    return F.substring(F.replace(F.translate(F.base64(F.unhex(F.sha2(c, 256))), "+/", "-_"), F.lit("="), F.lit("")), 1, size)


def utm(url: Column, field: str) -> Column:
    """A query parameter, percent- and plus-decoded; '' where the url or the parameter is missing or broken."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(field))), F.lit(""))


def quote_sheet(c: Column) -> Column:
    t = strip(c)
    return F.when(t.startswith("'") & t.endswith("'"), t).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'")))


def email_column_range(c: Column) -> Column:
    return F.concat(quote_sheet(F.split_part(c, F.lit("!"), F.lit(1))), F.lit("!B:B"))


def says_yes(c: Column) -> Column:
    """A model's yes, with or without accent."""
    u = F.upper(strip(c))
    return F.coalesce(u.startswith("SÍ") | u.startswith("SI"), F.lit(False))


def last_index(text: Column, part: str) -> Column:
    """Zero-based place of the last occurrence, -1 where there is none."""
    back = F.locate(part[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - (len(part) - 1)).otherwise(-1)


def labelled(c: Column, names: dict[str, str], default: str) -> Column:
    """Look a value up in a fixed mapping."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c], F.lit(default))


def parsed_json(c: Column, ddl: str, default: Column | None = None) -> Column:
    """A JSON text by its type; a text that is broken or does not fit gives null, or the default."""
    kind = DataType.fromDDL(ddl)
    if isinstance(kind, StructType):  # whose fields would all be null for a broken text
        out = F.from_json(c, StructType([*kind.fields, StructField(BROKEN, StringType())]), {"columnNameOfCorruptRecord": BROKEN})
        out = F.when(out.isNotNull() & out[BROKEN].isNull(), F.struct(*[out[n].alias(n) for n in kind.names]))
    else:
        out = F.from_json(c, kind)
    return out if default is None else F.coalesce(out, default)


def secret_token(row: Column, prefix: str = "") -> Column:
    """For each row a prefix and 32 random bytes as url-safe base64; a new one at each evaluation, so store it before using it twice.

    Spark's own ``uuid`` and ``randstr`` are not made for secrets, so the bytes come from the system's source.
    """

    @F.pandas_udf("string")
    def make(rows: pd.Series) -> pd.Series:
        return pd.Series([prefix + secrets.token_urlsafe(32) for _ in range(len(rows))])

    return make.asNondeterministic()(row)


def one_time_code(row: Column) -> Column:
    """For each row six random digits, the first not zero; a new one at each evaluation."""

    @F.pandas_udf("string")
    def make(rows: pd.Series) -> pd.Series:
        return pd.Series([str(100000 + secrets.randbelow(899999)) for _ in range(len(rows))])

    return make.asNondeterministic()(row)
