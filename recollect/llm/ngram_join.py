"""N-gram Jaccard self-join by a token-group matrix: exact components of near-duplicate texts.

A document's set holds its distinct five-word shingles; a text of one to four words is one shingle, a text
without words has an empty set and links with nothing. Two documents link when 100 * intersection >=
80 * union. The result is exact up to collisions of 64-bit hashes.

1. Equal sets form one class, and only classes go on; copies cost nothing beyond their own row.
2. A global order puts frequent shingles last (which ones those are changes the cost only: any order is right).
   Linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each, so only those are shuffled, and
   of them only the ones that two classes have.
3. Classes with the same most frequent shared shingle and alike in size form groups of bounded size. The token-group matrix holds each
   group's union of such shingles with the range of set sizes.
4. The number of shingles that a class shares with a group bounds every overlap in that group from above; only
   qualifying (class, group) pairs are opened. An opened group is built into an inverted index of its full
   sets, its union is checked once more against the full query set, and overlaps are counted exactly.
5. First, each class opens its own group and the pivot group that most of its shingles name: linear in the
   data. What that links is contracted to components; then all remaining qualifying groups outside the
   component are opened. So a family of thousands of near copies never meets itself pair by pair.

Nothing is capped, sampled or dropped: groups too large are split and opened one by one, a group with many
queries is dealt to several tasks, hot shingles are joined in the JVM where AQE splits them.

Null and empty texts give n_shingles 0 and their own id as component. Repeated rows and ties fall in one
class. With a null id a row still links; the smallest non-null id names the component. Texts count whole, however long. Empty
tables give empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget, give_back, mix, steps, table, word_hashes
from .components import connected_components
from .packed import bucket_edges, pack, pack_sorted, unpack, unpack_sorted

SHINGLE = 5
#: Shingles of so many sets are hot and ordered last; leading hash bits that the bitmap of them tells apart (4 MB, broadcast).
HOT, HOT_BITS = 16, 25
#: Shingles that are counted at once.
CHUNK = 1_000_000
#: A group's sets differ in size by this factor at most, and it is split beyond so many classes or shingles.
GROUP_RATIO = 1.12
GROUP_CLASSES, GROUP_TOKENS = 256, 500_000
#: Queries of one group that one task handles, as many as a group has members.
QUERIES = 256
#: Bits of the filter that spares unneeded texts the shuffle; when it fills up, more texts pass, none less.
FILTER_BITS = 1 << 23
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, lens = word_hashes(texts)
    ends = np.cumsum(lens)
    with np.errstate(over="ignore"):
        if len(h) >= SHINGLE:
            s = h[: len(h) - SHINGLE + 1] * MULTIPLIERS[0]
            for k in range(1, SHINGLE):
                s = s + h[k : len(h) - SHINGLE + 1 + k] * MULTIPLIERS[k]
            s = mix(s)
        out = []
        for end, n in zip(ends.tolist(), lens.tolist(), strict=True):
            if n >= SHINGLE:
                out.append(np.unique(s[end - n : end - SHINGLE + 1]))
            elif n:
                out.append(mix(np.sum(h[end - n : end] * MULTIPLIERS[:n], dtype=np.uint64, keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int) -> int:
    return n - -(-8 * n // 10) + 1


def hot_filter(texts: DataFrame) -> np.ndarray:
    """A bitmap of the leading hash bits of the shingles that HOT sets or more have.

    Counted over all texts, in packed blocks of hashes cut to 40 bits. Other shingles that share a count or a bit are taken for
    hot too, which changes the order but nothing else.
    """
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held) >> np.uint64(24), return_counts=True)
            keys <<= np.uint64(24)
            edges = bucket_edges(keys, buckets)
            full = np.flatnonzero(np.diff(edges))
            cut = [(edges[i], edges[i + 1]) for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full), pa.array([pack_sorted(keys[s:e]) for s, e in cut], pa.binary()), pa.array([pack(n[s:e].astype(np.int32)) for s, e in cut], pa.binary())], names=["bucket", "keys", "n"])

        for _, part in steps(batches, text=0):
            sets = shingle_sets(part)
            held += sets
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            keys, back = np.unique(np.concatenate([unpack_sorted(r["keys"]) for r in rows]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([unpack(r["n"], np.int32) for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array([pack_sorted(np.unique(keys[n >= HOT] >> np.uint64(64 - HOT_BITS)))], pa.binary())], names=["bits"])

        bucket, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if rows and r["bucket"] != bucket:
                    yield flush(rows)
                    rows = []
                bucket = r["bucket"]
                rows.append(r)
        if rows:
            yield flush(rows)
        rows = []
        give_back()

    out = np.zeros(1 << HOT_BITS - 3, np.uint8)
    asked = texts.mapInArrow(count, "bucket long, keys binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    for r in asked.mapInArrow(hot, "bits binary").collect():
        at = unpack_sorted(bytes(r["bits"])).astype(np.int64)
        np.bitwise_or.at(out, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
    return out


def is_hot(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - HOT_BITS)).astype(np.int64)
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1) > 0


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """Words (w, b) joined to one bitmap; as many rows as it has words come back at most, as Arrow columns."""
    out = np.zeros(bits // 32, np.uint32)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out


def measured(df: DataFrame, hot: np.ndarray) -> DataFrame:
    """(id, key, n, node, prefix array<long> in the global order). df: (id, text, key)."""
    shared = df.sparkSession.sparkContext.broadcast(hot)
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            sets = shingle_sets(texts)
            prefixes = []
            for s in sets:
                late = is_hot(shared.value, s)
                prefixes.append(np.concatenate([s[~late], s[late]])[: prefix_size(len(s))] if len(s) else s)
            sizes = np.fromiter(map(len, prefixes), np.int32, len(prefixes))
            flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), lists], names=["id", "key", "n", "node", "prefix"])

    return df.select("id", "text", "key").mapInArrow(run, f"id {kind}, key long, n long, node long, prefix array<long>")


def qualifies(c="c", n="n", lo="lo", hi="hi"):
    """Whether c shared prefix shingles allow a link of a set of n with one of lo to hi.

    A linked pair shares at least 4/9 (n + m) shingles, of which fewer than 0.8 max(n, m) lie behind the
    earlier prefix end; the rest is among the shared prefix shingles. That bound is least at an end of the sizes.
    """
    low, high = F.greatest(F.col(lo), 0.8 * F.col(n)), F.least(F.col(hi), 1.25 * F.col(n))
    need = lambda m: 4 * (F.col(n) + m) / 9 - 0.8 * F.greatest(F.col(n), m)
    return (low <= high + 1e-6) & (F.col(c) + 1e-6 >= F.least(need(low), need(high)))


class Group:
    """An opened group: an inverted index of its members' full sets."""

    def __init__(self):
        self.nodes, self.comps, self.sets, self.parent = [], [], [], {}

    def add(self, node: int, comp: int, tokens: np.ndarray) -> None:
        self.nodes.append(node)
        self.comps.append(comp)
        self.sets.append(tokens)

    def build(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.union, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.sets = []

    def shared(self, q: np.ndarray) -> np.ndarray:
        """How many tokens of the query each member has; empty where the group's union has none."""
        at = np.searchsorted(self.union, q).clip(max=len(self.union) - 1)
        at = at[self.union[at] == q]
        if not len(at):
            return at
        n = self.count[at]
        slots = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[slots], minlength=len(self.nodes))

    def rehearse(self, node: int, n: int, q: np.ndarray) -> list[int]:
        """Members that may link by the bound on shared prefix shingles; members hold prefixes, comps their sizes."""
        if not len(self.union) or not len(c := self.shared(q)):
            return []
        m = np.array(self.comps, np.float64)
        need = 4 * (n + m) / 9 - 0.8 * np.maximum(n, m)
        fit = (c > 0) & (c + 1e-6 >= need) & (m + 1e-6 >= 0.8 * n) & (0.8 * m <= n + 1e-6)
        return [self.nodes[i] for i in np.flatnonzero(fit) if self.nodes[i] != node]

    def find(self, c: int) -> int:
        while (p := self.parent.get(c, c)) != c:
            self.parent[c] = self.parent.get(p, p)
            c = p
        return c

    def links(self, node: int, comp: int, q: np.ndarray) -> list[tuple[int, int]]:
        """New links of components that this query makes."""
        if not len(self.union):
            return []
        hits = np.searchsorted(self.union, q).clip(max=len(self.union) - 1)
        if 9 * (self.union[hits] == q).sum() < 4 * (len(q) + max(self.sizes.min(), 0.8 * len(q))):
            return []  # the group's union bounds every overlap
        overlap = self.shared(q)
        out = []
        for s in np.flatnonzero(9 * overlap >= 4 * (len(q) + self.sizes)):
            a, b = self.find(comp), self.find(self.comps[s])
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((comp, self.comps[s]))
        return out


def dealt(members: DataFrame, opens: DataFrame, own: bool, size: str, tokens: str) -> DataFrame:
    """The rows of opened groups, (g, salt, kind, node, size, tokens), each group's together and dealt by salt.

    members: (node, g, size, tokens); opens: (node, g) queries of other groups. Kind 0 answers and kind 1 asks, where a group's members
    are repeated for each salt; with ``own`` every member also asks its own group, as kind 2 under a salt of its own.
    """
    columns = ["node", size, tokens]
    salts = opens.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    inside = members.join(salts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *columns)
    asking = opens.join(salts, "g").join(members.drop("g"), "node").select("g", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), *columns)
    rows = inside.unionByName(asking)
    if own:
        rows = rows.unionByName(members.select("g", F.lit(-1).alias("salt"), F.lit(2).alias("kind"), *columns))
    return rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "kind", "node")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, "Group", list[tuple]]]:
    """(g, salt, opened group, queries (node, size, tokens)) of rows that ``dealt`` gives; a group's queries come a batch at a time."""
    key, group, ready, asked = None, None, False, []

    def ask():
        nonlocal ready, asked
        if not ready:
            group.build()
            ready = True
        out, asked = asked, []
        return key[0], key[1], group, out

    for b in batches:
        if not b.num_rows:
            continue
        last = b.column(5)
        edges = np.frombuffer(last.buffers()[1], np.int32)[last.offset : last.offset + len(last) + 1]
        if pa.types.is_list(last.type):
            flat, edges = last.values.to_numpy().view(np.uint8), edges.astype(np.int64) * 8
        else:
            flat = np.frombuffer(last.buffers()[2] or b"", np.uint8)
        for i, (g, salt, kind, node, size) in enumerate(zip(*[c.to_pylist() for c in b.columns[:5]], strict=True)):
            if (g, salt) != key:
                if asked:
                    yield ask()
                key, group, ready = (g, salt), Group(), False
            row = (node, size, flat[edges[i] : edges[i + 1]].view(np.uint64))
            if kind != 1:
                group.add(*row)
            if kind != 0:
                asked.append(row)
        if asked and key[1] >= 0:  # under its own salt a group is whole only at its end
            yield ask()
    if asked:
        yield ask()
    key = group = asked = None
    give_back()


def gathered(parts: Iterator[np.ndarray], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Small integer matrices, one column per name, as record batches of some thousand rows."""
    held, size = [], 0
    for p in parts:
        if len(p):
            held.append(p)
            size += len(p)
        if size >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(np.concatenate(held).T, types, strict=True)], names=names)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(np.concatenate(held).T, types, strict=True)], names=names)


def rehearsed(opens: DataFrame, units: DataFrame, own: bool, scratch: Scratch, name: str) -> DataFrame:
    """Of the (class, group) pairs that a group's union lets through, those that some member's own bound lets through.

    opens: (node, g); units: (node, g, n, toks), the shared prefix shingles. Gives
    (node, g, kind): 1 queries of other groups and 2 of the own group, and with 0 members that a query may link with. Full sets are loaded for these
    only.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for g, salt, group, asked in groups_of(batches):
            hit, out = set(), []
            for node, n, toks in asked if len(group.nodes) > (salt < 0) else []:
                if len(may := group.rehearse(node, n, toks)):
                    out.append((node, g, 2 if salt < 0 else 1))
                    hit.update(may)
            yield np.array(out + [(node, g, 0) for node in sorted(hit)], np.int64).reshape(-1, 3)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(found(batches), ["node", "g", "kind"], [pa.int64(), pa.int64(), pa.int32()])

    return scratch.keep(dealt(units, opens, own, "n", "toks").mapInArrow(match, "node long, g long, kind int"), f"{name}-rehearsed")


def opened(df: DataFrame, opens: DataFrame, active: DataFrame, own: bool, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) between components that opening finds.

    df: (id, text); opens: (node, g) queries of other groups; active: (node, g, comp), all nodes that query or can answer; with ``own``
    they also query their own groups.
    """
    spark = df.sparkSession
    bit = F.pmod("node", F.lit(FILTER_BITS))
    words = active.select(F.floor(bit / 32).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {FILTER_BITS}) & 31 as int))").alias("b"))
    shared = spark.sparkContext.broadcast(bitmap(words, FILTER_BITS))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for _, texts in steps(batches, text=0):
            nodes, sets = [], []
            for s in shingle_sets(texts):
                if len(s):
                    node = node_of(s)
                    k = node % FILTER_BITS
                    if bits[k >> 5] >> np.uint32(k & 31) & 1 and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    sets = df.select("text").mapInArrow(load, "node long, tokens binary").join(active, "node").dropDuplicates(["node"])
    sets = scratch.keep(sets.select("node", "g", "comp", "tokens"), f"{name}-sets")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, salt, group, asked in groups_of(batches):
            if len(group.nodes) > (salt < 0):
                yield np.array([link for node, comp, toks in asked for link in group.links(node, comp, toks)], np.int64).reshape(-1, 2)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(found(batches), ["a", "b"], [pa.int64(), pa.int64()])

    return scratch.keep(dealt(sets, opens, own, "comp", "tokens").mapInArrow(match, "a long, b long"), f"{name}-links")


def named(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n, node) and components (node, component) of the classes that link with others."""
    df = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    df = df.withColumn("key", row_key("id", "text"))
    rows = scratch.keep(measured(df, hot_filter(df.select("text"))), "rows")
    tokens = rows.where("n > 0").groupBy("node").agg(F.first(F.struct("n", "prefix")).alias("x")).select("node", "x.n", F.explode("x.prefix").alias("tok"))
    shared = tokens.join(tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "tok")
    # classes with their shared prefix shingles, at most a fifth of a set, and groups
    classes = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("x"))
    size = F.floor(F.log("n") / np.log(GROUP_RATIO)).cast("int")
    classes = classes.select("node", "n", F.col("x.tok").alias("toks"), F.xxhash64(F.element_at("x", -1)["tok"], size).alias("head"))
    classes = scratch.keep(classes, "classes")
    parts = classes.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / GROUP_CLASSES), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts")).where("parts > 1")
    parts = scratch.keep(parts, "large-heads")  # few, so that the join below does not gather a head's classes
    place = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    units = scratch.keep(classes.join(parts, "head", "left").select("node", "n", "toks", F.xxhash64("head", place).alias("g")), "units")
    scratch.drop("classes")
    scratch.drop("large-heads")
    spread = units.select("node", "n", "g", F.explode("toks").alias("tok"))
    matrix = spread.groupBy("tok", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # own groups, and of each class the pivot group that most of its shingles name
    bounds = [F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    pivots = matrix.groupBy("tok").agg(F.min(F.struct("g", "lo", "hi")).alias("p")).select("tok", F.col("p.g").alias("pg"), "p.lo", "p.hi")
    pivot = spread.join(pivots, "tok").where("g <> pg").select("node", "n", "pg", "lo", "hi").repartition("node").groupBy("node", "n", "pg").agg(*bounds).where(qualifies())
    pivot = scratch.keep(pivot.groupBy("node").agg(F.max_by("pg", F.struct("c", "pg")).alias("g")), "pivot")
    first = rehearsed(pivot, units, True, scratch, "first")
    home = units.select("node", "g")
    active = first.select("node").distinct().join(home, "node").withColumn("comp", F.col("node"))
    linked = connected_components(opened(df, first.where("kind = 1").select("node", "g"), active, True, scratch, "first"), scratch, "first-parts")
    linked = scratch.keep(linked, "linked")
    for name in ("pivot", "first-rehearsed", "first-sets", "first-links"):
        scratch.drop(name)
    # all other qualifying groups, outside what is linked already
    at = units.join(linked, "node", "left").select("node", "n", "g", F.coalesce("component", "node").alias("comp"), F.explode("toks").alias("tok"))
    others = at.groupBy("tok", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    others = scratch.keep(others.withColumnRenamed("g", "og"), "matrix")
    mixed = others.groupBy("tok").agg(F.min("c1").alias("x"), F.max("c2").alias("y")).where("x <> y").select("tok")
    pairs = at.join(others.join(mixed, "tok"), "tok").where("g > og AND (comp <> c1 OR comp <> c2) AND hi >= 0.8 * n AND lo <= 1.25 * n + 1e-6")
    cross = scratch.keep(pairs.groupBy("node", "n", "og").agg(*bounds).where(qualifies()).select("node", F.col("og").alias("g")), "cross")
    cross = rehearsed(cross, units, False, scratch, "cross")
    active = cross.select("node").distinct().join(home, "node").join(linked, "node", "left").select("node", "g", F.coalesce("component", "node").alias("comp"))
    more = connected_components(opened(df, cross.where("kind = 1").select("node", "g"), active, False, scratch, "cross"), scratch, "cross-parts")
    for name in ("cross", "cross-rehearsed", "cross-sets", "cross-links", "matrix", "units"):
        scratch.drop(name)  # what is left to do reads rows, linked and the last components
    more = more.withColumnsRenamed({"node": "comp", "component": "further"})
    every = linked.withColumnRenamed("component", "comp").unionByName(more.select(F.col("comp").alias("node"), "comp")).distinct()
    parts = every.join(more, "comp", "left").select("node", F.coalesce("further", "comp").alias("component"))
    return rows.select("id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), parts


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_key(id_col: str, text_col: str):
    """64 bits of a row's id and text, nulls told apart from other values."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row."""
    rows, parts = named(docs, scratch, id_col, text_col)
    names = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id")).join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "first_id")
    lowest = names.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    names = names.join(lowest, "comp").select("node", "component_id")
    return rows.join(names, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def deduplicated(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the one with the smallest id, with all columns; rows with a null id stay only where no other can.

    Of rows repeated with id and text one stays, whichever their other columns name. Rows without words link with nothing and all stay.
    """
    rows, parts = named(docs, scratch, id_col, text_col)
    best = rows.where("n > 0").join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("comp")).agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("x"))
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = whole.where(~blank).select("row", row_key("id", "text").alias("key")).join(best.select("x.key"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select("row.*").unionByName(whole.where(blank).select("row.*"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), Scratch(spark, "ngram-join"))


#: The same components by comparing every pair that shares a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN both_ways ON a = seen)
SELECT r.node AS doc_id, coalesce(n.n, 0) AS n_shingles, min(seen) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.node GROUP BY 1, 2
"""
