"""Secret scans: an Aho-Corasick keyword pass, anchored expressions at its hits, embedded checksums.

One pass over each text finds all keywords. Only where a keyword stands is its expression tried, anchored
there. Tokens whose format carries a checksum are accepted only when
it holds. Bare hexadecimal strings have no keyword; one expression of a character class scans each text for them.

Kinds, in the order in which spans at one start are listed:

* ``assign``  ``password = value`` and the like, value of 6 or more characters;
* ``access``  ``AKIA`` followed by capitals and digits, 20 or more characters in all;
* ``hex``     24 or more lower-case hexadecimal digits;
* ``github``  ``ghp_ gho_ ghu_ ghs_ ghr_`` + 30 characters + CRC-32 of them in 6 base-62 digits;
* ``npm``     ``npm_`` + 30 characters + CRC-32 of them in 6 base-62 digits.

Null and empty texts have no spans. Rows are judged one by one, so repeated rows and ties need no rule; an empty table gives an
empty result. ``scan`` reads no other columns; ``redact`` passes them on, and sets an integer column ``n_chars`` to the new length.
Texts are scanned whole; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import map_rows, steps, table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = {"github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: keyword in lower case -> kind
KEYWORDS = {k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base62_crc(payload: str) -> str:
    value, digits = zlib.crc32(payload.encode()), []
    for _ in range(6):
        value, d = divmod(value, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits))


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def spans_of(text: str, keywords) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every finding, sorted."""
    found = []
    # bytes.lower() touches A-Z only, so positions stay those of the text
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    last = dict.fromkeys(KINDS, 0)  # where a kind's previous match ended, kept or dropped
    for end, (size, kind) in keywords.iter(lower):
        at = end + 1 - size
        if at < last[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                last[kind] = m.end()
                if m.end(2) - m.start(2) >= 6:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                last[kind] = m.end()
                if m.end() - at >= 20:
                    found.append((at, 1, m.end()))
        elif (m := CHECKED[kind].match(text, at)) and base62_crc(m[1]) == m[2]:
            last[kind] = m.end()
            found.append((at, KINDS.index(kind), m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row per input row, spans by start and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch, texts in steps(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, keywords)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=[id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every finding in ``text_col`` replaced; overlapping findings count as one.

    Null stays null. A column ``n_chars`` of integers, where there is one, is set to the new length.
    """

    docs_columns = df.columns
    counted = "n_chars" in docs_columns and isinstance(df.schema["n_chars"].dataType, IntegralType)
    at = docs_columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for part, texts in steps(batches, text=at):
            null = part.column(at).is_null().to_pylist()
            out = [None if n else masked(t, spans_of(t, keywords), mask) for n, t in zip(null, texts, strict=True)]
            columns = list(part.columns)
            columns[at] = pa.array(out, part.schema.field(at).type)
            if counted:
                k = docs_columns.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(out, part.column(k).to_pylist(), strict=True)], part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return map_rows(df, run)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], mask]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
