"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs, in DataFrame expressions only.

A paragraph is a line, cut further behind ``.``, ``!`` and ``?`` before white space, since many tables hold a text in one or two lines. Each
paragraph is hashed to ``LANES`` bits; a fingerprint is the vector of the sums of these bits and the number of paragraphs, all modulo 2**32. So
the order of paragraphs does not matter, a paragraph is inserted or deleted by adding or subtracting its vector (``plus``, ``minus``), and
documents are joined by adding theirs. Two sums lie in one 64-bit number; sums are exact, as no text has 2**31 paragraphs. Each bit as
a sign, the vector of ``2 * sum - number`` has for its expected square the sum of squared multiplicities, and the product of
two vectors that of their common ones, so likeness is ``2 a b / (a a + b b)``: 1 only for equal vectors, with a
standard error of about 1 / sqrt(LANES). Different multisets get equal fingerprints with a chance below 2**-100 unless XXH64 is attacked.

The next document is found by one exchange of the texts: numbers that split (id, hash of the text) into even stretches are taken from a pass over
ids and hashes, 24 bytes a row, each row goes to its stretch and the greatest row of a stretch to the stretch above as well, so that
``lead`` inside a stretch sees the row below it. The driver gets one id and hash a stretch.

Null and empty texts have no paragraph: all sums are 0, and two of them are alike (1.0). Null ids come last in the descending order; rows of
one id are in the descending order of their texts' hashes, and equal rows are interchangeable (they share a stretch). One document is its own next one.
Empty tables give an empty result. Texts are read whole. Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

LANES = 128
#: A stretch has a quarter of the advisory size of a partition, from LEAST on; larger ones where there would be more than MOST of them.
LEAST, MOST = 1 << 20, 200_000
PARAGRAPH = "\\n+|(?<=[.!?])\\s+"
#: Bits k and k + 32 of a hash are the two lanes of its k-th number.
PAIR, HALF = (1 << 32) + 1, (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH, -1), lambda p: p != "")


def paragraph_hashes(paragraph: Column) -> list[Column]:
    """The hashes of a paragraph that hold its lanes; null for none."""
    return [F.when(paragraph.isNotNull(), F.xxhash64(paragraph, F.lit(seed))) for seed in range(LANES // 64)]


def summed(hashes: list[Column]) -> Column:
    """The fingerprint of the paragraphs with these hashes, as an aggregate over rows: an array of their number, then two lanes a number."""
    each = [F.shiftrightunsigned(h, k).bitwiseAND(PAIR) for h in hashes for k in range(32)]
    return F.array(F.count(hashes[0]), *[F.coalesce(F.sum(x), F.lit(0).cast("long")) for x in each])


def lanes(v: Column) -> Column:
    """The single lanes of a fingerprint array."""
    return F.flatten(F.transform(F.slice(v, 2, LANES // 2), lambda x: F.array(x.bitwiseAND(HALF), F.shiftrightunsigned(x, 32))))


def _by_halves(a: Column, b: Column, sign: int) -> Column:
    part = lambda x, y: (x + sign * y).bitwiseAND(HALF)
    return F.zip_with(a, b, lambda x, y: F.shiftleft(part(F.shiftrightunsigned(x, 32), F.shiftrightunsigned(y, 32)), 32).bitwiseOR(part(x.bitwiseAND(HALF), y.bitwiseAND(HALF))))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _by_halves(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a multiset without the paragraphs of another that it holds."""
    return _by_halves(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprint arrays, from 0 to 1."""
    signed = lambda v: F.transform(lanes(v), lambda x: (2 * x - F.get(v, 0)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    pair = F.struct(signed(a).alias("x"), signed(b).alias("y"))
    sizes = F.transform(F.array(pair), lambda v: F.struct(dot(v["x"], v["y"]).alias("xy"), (dot(v["x"], v["x"]) + dot(v["y"], v["y"])).alias("both")))
    s = F.get(sizes, 0)
    return F.get(F.transform(sizes, lambda s: F.when(s["both"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 2 * s["xy"] / s["both"]))), 0)


def as_text(v: Column) -> Column:
    """A fingerprint as hexadecimal digits: 16 for the number of paragraphs and for each two lanes."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def stretch_tops(keys: DataFrame) -> list[dict]:
    """The greatest (id, h) of each stretch of the rows keys (id, h, size), ascending; the last is the greatest of all."""
    spark = keys.sparkSession
    total = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.max(F.struct("id", "h")).alias("top")).first()
    if not total["rows"]:
        return []
    advised = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    size = max(LEAST, advised // 4, total["size"] // MOST)
    step = max(1, total["rows"] * size // max(1, total["size"]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select("id", "h").repartitionByRange(parts, F.asc_nulls_first("id"), "h").sortWithinPartitions(F.asc_nulls_first("id"), "h")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    tops = {(r["id"], r["h"]) for r in dealt.withColumn("place", place).where(F.col("place") % step == step - 1).select("id", "h").collect()}
    tops.add((total["top"]["id"], total["top"]["h"]))
    return [{"id": i, "h": h} for i, h in sorted(tops, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))]


def in_stretches(rows: DataFrame, tops: list[dict]) -> DataFrame:
    """rows (id, h, ...) with the number ``b`` of their stretch; the greatest row of each is a ``guest`` of the next one as well, that of the last of the first."""
    kind = rows.select(F.array(F.struct("id", "h")).alias("x")).schema["x"].dataType.simpleString()
    bounds, key = F.from_json(F.lit(json.dumps(tops)), kind), F.struct("id", "h")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(tops).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(tops)) & (F.get(bounds, at + s - 1) < key), at + s).otherwise(at))
    own, guest = (F.struct(b.cast("int").alias("b"), F.lit(g).alias("guest")) for b, g in ((F.col("_b"), False), ((F.col("_b") + 1) % len(tops), True)))
    placed = rows.withColumn("_b", below)
    at = F.explode(F.when(F.get(bounds, F.col("_b")).eqNullSafe(key), F.array(own, guest)).otherwise(F.array(own)))
    return placed.withColumn("_at", at).select("_at.b", "_at.guest", *rows.columns)


def with_fingerprints(docs: DataFrame, scratch: Scratch, edit, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of each row of docs; fingerprints are arrays.

    ``edit(text, following)`` makes the edited text from a text and that of the next document in descending order of ids (numbers); both are never null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    tops = stretch_tops(scratch.keep(rows.select("id", "h", F.octet_length("text").alias("size")), "keys"))
    scratch.close()
    kind = "array<bigint>"
    if not tops:
        return rows.select("id", F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"), *[F.lit(None).cast(kind).alias(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")])
    order = Window.partitionBy("b").orderBy("guest", F.desc_nulls_last("id"), F.desc("h"))
    met = in_stretches(rows, tops).select("b", "guest", "id", "text", F.lead("text").over(order).alias("following"), F.row_number().over(order).alias("r"))
    met = met.withColumn("edited", F.when(~F.col("guest"), edit(F.col("text"), F.coalesce("following", F.lit("")))).otherwise(F.lit("")))

    def units(text: str, side: int) -> Column:  # a null one at the end, so that no side is without a row
        return F.transform(F.concat(paragraphs(F.col(text)), F.array(F.lit(None).cast("string"))), lambda p: F.struct(F.lit(side).alias("side"), p.alias("p")))

    own = ["b", "r", "guest", "id", "n_chars", "edited_sha256"]
    parts = F.concat(units("text", 0), units("edited", 1)).alias("parts")
    pieces = met.select(*own[:4], F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), parts)
    # outer: an inner explode would have a filter that makes all parts once more
    pieces = pieces.select(*own, F.explode_outer("parts").alias("x"))
    hashes = [h.alias(f"h{k}") for k, h in enumerate(paragraph_hashes(F.col("x.p")))]
    pieces = pieces.select(*own, "x.side", *hashes)
    each = pieces.groupBy(*own, "side").agg(summed([F.col(f"h{k}") for k in range(len(hashes))]).alias("f"))
    both = each.groupBy(*own).agg(*[F.max(F.when(F.col("side") == k, F.col("f"))).alias(c) for k, c in enumerate(("fingerprint", "edited_fingerprint"))])
    after = F.lead("fingerprint").over(Window.partitionBy("b").orderBy("r"))
    return both.withColumn("next_fingerprint", after).where("NOT guest").select(*own[3:], "fingerprint", "edited_fingerprint", "next_fingerprint")


def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of the contract's edited texts: the last third gives way to the beginning of the next document."""

    def edit(text: Column, following: Column) -> Column:
        cut = F.floor(F.char_length(text) / 3).cast("int")
        return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))

    got = with_fingerprints(table(spark, sf_dir, "documents"), Scratch(spark, "multiset-hash"), edit)
    got = got.withColumnsRenamed({"id": "doc_id", "fingerprint": "own", "edited_fingerprint": "edited", "next_fingerprint": "following"})
    own, edited, following = F.col("own"), F.col("edited"), F.col("following")
    texts = [as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint")]
    return got.select("doc_id", "n_chars", "edited_sha256", *texts, likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"))
