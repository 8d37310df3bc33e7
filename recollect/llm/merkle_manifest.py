"""Merkle manifest of a table: digests of rows, a tree of eight-fold nodes for each group and one over the groups' roots, with proofs.

Rows of a group are numbered in the order of a key: the small rows (group, key, digest) are dealt by ranges and sorted, and offsets of the
partitions are summed, so no group lies in one task. The tree is built by superblocks: a row's bucket is its number over ``FANOUT**LEVELS``, one
``applyInPandas`` call collapses ``LEVELS`` levels of a bucket, and the roots of the buckets are rows of the next round until one is left of
each group. On the way back a bucket meets the proof of its root and puts its rows' own siblings before it: lower and upper proof. A bucket has 4,096
rows of one digest each, whatever the table's size; three rounds cover 10^10 rows a group.

Order and ties: groups and keys ascend, null first, strings by their UTF-8 bytes; rows of one group and key are ordered by their digest, and
rows that repeat all three are alike, so any order gives the same tree. A group of one row is its own root, an empty table has no root and no rows.
Null fields are told from empty ones. Texts are hashed whole in the JVM and never shuffled. Columns of any name are passed on.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FANOUT, LEVELS = 8, 4
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """Hex SHA-256 of fields, each ``-`` if null, else the number of its UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows (g, o, h, ...) with ``i``, a row's number within g by o and h, and ``n``, the rows of g."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "g", "o", "h").sortWithinPartitions("g", "o", "h")
    dealt = scratch.keep(dealt.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), f"{name}-sorted")
    pieces = dealt.groupBy("g", "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))  # a row a group and partition
    running, whole = "sum(_c) OVER (PARTITION BY g ORDER BY _p)", "sum(_c) OVER (PARTITION BY g)"
    pieces = pieces.select(F.col("g").alias("_g"), F.col("_p").alias("_q"), (F.expr(running) - F.col("_c") - F.col("_first")).alias("_shift"), F.expr(whole).alias("n"))
    both = dealt.join(pieces, (F.col("_p") == F.col("_q")) & F.col("g").eqNullSafe(F.col("_g")))
    return both.withColumn("i", F.col("_m") + F.col("_shift")).drop("_g", "_p", "_q", "_m", "_c", "_shift")


def collapse(leaves: list[str], single: bool) -> list[list[str]]:
    """The levels of a superblock from its leaves up: ``LEVELS`` of them, or as many as leave one node if it is the only one of its group."""
    rounds = [leaves]
    while len(rounds[-1]) > 1 if single else len(rounds) <= LEVELS:
        below = rounds[-1]
        rounds.append([sha256("".join(below[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(below), FANOUT)])
    return rounds


def _values(column: pd.Series) -> list:
    return [None if x is None or x != x else x for x in column.tolist()]


def _root(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("i")
    n = int(block["n"].iloc[0])
    top = collapse(block["h"].tolist(), n <= FANOUT**LEVELS)[-1][0]
    return pd.DataFrame({"g": _values(block["g"].iloc[:1]), "i": [int(block["b"].iloc[0])], "n": [-(-n // FANOUT**LEVELS)], "h": [top]})


def _proofs(block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
    """Rows of a superblock with their proofs, the superblock's own proof behind."""
    block = block.sort_values("i")
    rounds = collapse(block["h"].tolist(), int(block["n"].iloc[0]) <= FANOUT**LEVELS)
    proofs, places = [list(upper["proof"].iloc[0])], [[int(k) for k in upper["places"].iloc[0]]]
    for below in reversed(rounds[:-1]):
        starts = [k - k % FANOUT for k in range(len(below))]
        proofs = [["".join(below[s:k] + below[k + 1 : s + FANOUT]), *proofs[k // FANOUT]] for k, s in enumerate(starts)]
        places = [[k - s, *places[k // FANOUT]] for k, s in enumerate(starts)]
    same = {c: _values(block[c]) for c in ("g", "i", "o", "h", "x")}
    return pd.DataFrame(same | {"top": [upper["top"].iloc[0]] * len(block), "proof": proofs, "places": places})


def trees(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (g, o, h, x) as (g, i, o, h, x, top, proof, places): a row's number i in its group, the root of the group's tree, and for every level
    from the row up the other digests of its run in one string and its place in the run. The key o comes back as a string; x is a string of
    the caller's. The second table has the roots alone (g, h)."""
    block = F.floor(F.col("i") / FANOUT**LEVELS).alias("b")
    first = numbered(rows, scratch, name).select("g", "i", "n", block, F.col("o").cast("string").alias("o"), "h", "x")
    levels = [scratch.keep(first, f"{name}-0")]
    while (levels[-1].agg(F.max("n").alias("n")).first()["n"] or 1) > 1:
        below = levels[-1].select("g", "b", "i", "n", "h")
        up = below.groupBy("g", "b").applyInPandas(_root, below.drop("b").schema)
        levels.append(scratch.keep(up.select("g", "i", "n", block, F.lit(None).cast("string").alias("o"), "h", F.lit(None).cast("string").alias("x")), f"{name}-{len(levels)}"))
    done = levels[-1].select("g", "i", "o", "h", "x", F.col("h").alias("top"), F.array().cast("array<string>").alias("proof"), F.array().cast("array<int>").alias("places"))
    for level in reversed(levels[:-1]):
        upper = done.select("g", F.col("i").alias("b"), "top", "proof", "places")
        done = level.groupBy("g", "b").cogroup(upper.groupBy("g", "b")).applyInPandas(_proofs, done.schema)
    return done, levels[-1].select("g", "h")


def fold(leaf: Column, proof: Column, places: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    steps = F.arrays_zip(proof.alias("s"), places.alias("k"))
    return F.aggregate(steps, leaf, lambda h, x: F.sha2(F.concat(F.substring(x["s"], F.lit(1), x["k"] * HEX), h, F.substring(x["s"], x["k"] * HEX + 1, F.length(x["s"]))), 256))


def manifest(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (g, o, h, x) as ``trees`` tells, with ``subroot``, the root of the group, ``root``, that of all groups, and proof and places up to it."""
    groups, tops = trees(rows, scratch, "rows")
    over, _ = trees(tops.select(F.lit("").alias("g"), F.col("g").alias("o"), "h", F.lit(None).cast("string").alias("x")), scratch, "groups")
    over = scratch.keep(over.select(F.col("o").alias("_o"), F.col("top").alias("root"), F.col("proof").alias("_proof"), F.col("places").alias("_places")), "roots")
    both = groups.join(over, F.col("g").eqNullSafe(F.col("_o")))
    return both.select("g", "i", "o", "h", "x", F.col("top").alias("subroot"), "root", F.concat("proof", "_proof").alias("proof"), F.concat("places", "_places").alias("places"))


def _oracle(levels: int = 7, over: int = 3) -> str:
    """The same by joins of unrolled levels; CRC-32 by its polynomial."""
    f = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"
    leaf = lambda text: "sha256(" + " || ".join([*map(f, ("doc_id", "source", "lang", "n_chars")), f(text)]) + ")"
    crc = """list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ord(c) AS UBIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS UBIGINT[])), lambda x, i: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1))))"""
    parts = [
        f"d AS (SELECT *, row_number() OVER () AS r, {leaf('text')} AS leaf, {leaf('low')} AS spoiled FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents))",
        f"t AS (SELECT *, CASE WHEN xor({crc}, CAST(4294967295 AS UBIGINT)) % 3 = 0 THEN spoiled ELSE leaf END AS shown FROM d)",
        "n0 AS (SELECT r, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d)",
        "p0 AS (SELECT n0.r, g, i, shown AS f, '' AS proof FROM n0 JOIN t USING (r))",
    ]

    def climb(node: str, at: str, count: int) -> tuple[str, str]:
        for k in range(count):
            a, b = f"{node}{k}", f"{at}{k}"
            parts.append(f"{node}{k + 1} AS (SELECT g, i // {FANOUT} AS i, any_value((n + {FANOUT - 1}) // {FANOUT}) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {a} GROUP BY g, {a}.i // {FANOUT})")
            parts.append(
                f"s{a} AS (SELECT x.g, x.i, any_value(x.n) AS n, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS m FROM {a} x JOIN {a} y ON x.g IS NOT DISTINCT FROM y.g AND x.i // {FANOUT} = y.i // {FANOUT} GROUP BY x.g, x.i)"
            )
            parts.append(f"{at}{k + 1} AS (SELECT r, {b}.g, {b}.i // {FANOUT} AS i, CASE WHEN n = 1 THEN f ELSE sha256(l || f || m) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || l || m END AS proof FROM {b} JOIN s{a} ON {b}.g IS NOT DISTINCT FROM s{a}.g AND {b}.i = s{a}.i)")
        return f"{node}{count}", f"{at}{count}"

    tops, rows = climb("n", "p", levels)
    parts.append(f"o0 AS (SELECT 0 AS g, g AS name, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM {tops})")
    parts.append(f"q0 AS (SELECT r, 0 AS g, o0.i, f, proof FROM {rows} p JOIN o0 ON p.g IS NOT DISTINCT FROM o0.name)")
    root, rows = climb("o", "q", over)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, {tops}.h AS subroot, {root}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = {root}.h AS verified FROM {rows} q JOIN d USING (r) JOIN {tops} ON {tops}.g IS NOT DISTINCT FROM d.lang, {root}"


#: For at most FANOUT**7 rows a language and FANOUT**3 languages.
ORACLE = _oracle()


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, and what each proof gives for rows of which every third, by the CRC-32 of its id, was lower-cased."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "merkle-manifest")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    spoiled = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    rows = docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("o"), digest(*fields, F.col("text")).alias("h"), F.when(spoiled, digest(*fields, F.translate("text", UPPER, LOWER))).alias("x"))
    got = manifest(scratch.keep(rows, "leaves"), scratch).withColumn("folded_root", fold(F.coalesce("x", "h"), F.col("proof"), F.col("places")))
    return got.select(
        F.col("o").cast("long").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
