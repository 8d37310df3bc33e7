"""Periodic runs of words: stretches that repeat one block of words, by the runs theorem.

In a run of period p the repeated block has a rotation that is a Lyndon word under one of two opposite orders of the alphabet, and that
rotation is the longest Lyndon word at its place. So of every place and either order one candidate is enough: the root from the place to the
next one whose suffix is smaller, found in the inverse suffix array. A root is extended to the right by the longest common
prefix of its place and its end, which is a minimum over the LCP array between their ranks, answered by a sparse table, and to the
left by the same on the reversed words. Each text is a row of its own; a task sorts the suffixes of many texts at once in numpy.

A run that is told is at least ``least`` words and ``periods`` periods long. The first Lyndon root of such a run reaches so far to the right
that only places whose suffix shares ``reach`` words with a neighbour in the order can begin one; texts without such places end there.

Words are stretches without ASCII white space, compared exactly (no hashes, no folding). Null and empty texts have no words, no runs and
an empty collapsed text. Every row is judged alone: null ids, repeated rows and ids change nothing, other columns are passed on whatever they are
called. Texts are read whole; a task needs some 200 bytes a word of its longest text. Ties do not occur: a run is told once, by start, then period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from copy import copy
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_CHARS, give_back, small_batches, table

LEAST, PERIODS = 24, 3
#: Pairs of places that are compared at once, and words of a block that one comparison takes at most.
PAIRS, BLOCK = 1 << 19, 256
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
GAP = "[ \\t-\\r]+"


def reach(least: int, periods: int) -> int:
    """Words that the first root of a run shares at least with the place one period on."""
    return min(max(least, periods * p) - 2 * p + 1 for p in range(1, least // periods + 3))


class Suffixes:
    """Suffix array, its inverse and LCP values of several sequences at once.

    ``words`` holds the sequences one after another, each closed by a 0, all other values being positive; ``doc`` is the sequence's number at
    each place. The suffixes of a sequence are sorted among themselves, so its ranks are the same stretch as its places. With ``deep``,
    sequences without two suffixes that share about as many words are left unsorted and ``kept`` tells the others.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, deep: int = 0):
        self.words, self.doc = words, doc
        size, docs = len(words), int(doc[-1]) + 1
        bits = int(words.max()).bit_length() or 1
        taken = max(1, min(4, deep or 4, (63 - docs.bit_length()) // bits))
        ahead = np.concatenate([words, np.zeros(taken, np.int64)])
        key = doc.astype(np.int64)
        for t in range(taken):
            key = key << bits | ahead[t : t + size]
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(size, np.int64)
        slots, shared = np.arange(size), taken
        self.kept = None if deep else np.ones(docs, bool)
        while True:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            heads = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            rank[order[slots]] = heads
            alone = new & np.concatenate([new[1:], [True]])
            slots = slots[~alone]
            if self.kept is None and 2 * shared > deep:
                self.kept = np.zeros(docs, bool)
                self.kept[doc[order[slots]]] = True
            if not len(slots):
                break
            places = order[slots]
            key = rank[places] * size + rank[places + shared]
            by = np.argsort(key)
            order[slots], key = places[by], key[by]
            shared *= 2
        if self.kept is None:
            self.kept = np.zeros(docs, bool)
        self.order, self.rank = order, rank

    def kept_ones(self) -> tuple[np.ndarray, "Suffixes"]:
        """The numbers of the sorted sequences, and these alone."""
        names, inside = np.flatnonzero(self.kept), self.kept[self.doc]
        move, part = np.cumsum(inside) - 1, copy(self)
        part.words, part.doc, part.kept = self.words[inside], np.searchsorted(names, self.doc[inside]), self.kept[names]
        part.order, part.rank = move[self.order[inside]], move[self.rank[inside]]
        return names, part

    def lcp(self) -> np.ndarray:
        """By place: the words that its suffix shares with the next smaller one of its sequence; only few of them are compared, as
        the value falls by one to the next place wherever the words before both are equal."""
        size = len(self.words)
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        has = ~first[self.rank]
        before = np.where(has, self.order[np.maximum(self.rank - 1, 0)], 0)
        follows = has & ~first & ~first[before]
        follows[1:] &= has[:-1]
        follows &= self.words[np.arange(size) - 1] == self.words[before - 1]
        fresh = np.flatnonzero(~follows)
        own = np.zeros(len(fresh), np.int64)
        real = has[fresh]
        own[real] = common(self.words, fresh[real], before[fresh[real]])
        value = np.zeros(size, np.int64)
        value[fresh] = own + fresh
        last = np.maximum.accumulate(np.where(follows, 0, np.arange(size)))
        return np.where(has, value[last] - np.arange(size), 0)


def common(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words from places a and b on; both of a pair lie in one sequence, whose end stops them."""
    padded = np.concatenate([words, np.zeros(BLOCK, np.int64)])
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        left, width = np.arange(at, min(at + PAIRS, len(a))), 4
        while len(left):
            for part in np.array_split(left, max(1, len(left) * width // (4 * PAIRS))):
                step = np.arange(width)
                same = padded[(a[part] + out[part])[:, None] + step] == padded[(b[part] + out[part])[:, None] + step]
                out[part] += np.where(same.all(1), width, same.argmin(1))
            left = left[padded[a[left] + out[left]] == padded[b[left] + out[left]]]
            width = min(2 * width, BLOCK)
    return out


def next_smaller(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first place behind each of ``places`` with a smaller value, or the length: up and down a tree of minima."""
    size = 1 << max(1, int(len(values)).bit_length())
    tree = [np.concatenate([values, np.full(size - len(values), np.iinfo(np.int64).min)])]
    while len(tree[-1]) > 1:
        tree.append(np.minimum(tree[-1][::2], tree[-1][1::2]))
    want, node, at = values[places], places + 1, np.zeros(len(places), np.int64)
    found, open_ = np.zeros(len(places), np.int64), np.arange(len(places))
    for level, low in enumerate(tree):
        odd = (node[open_] & 1 == 1) | (len(low) == 1)
        hit = odd & (low[np.minimum(node[open_], len(low) - 1)] < want[open_])
        at[open_[hit]], found[open_[hit]] = level, node[open_[hit]]
        open_, odd = open_[~hit], odd[~hit]
        node[open_] = node[open_] + odd >> 1
    for level in range(len(tree) - 1, 0, -1):
        down = np.flatnonzero(at == level)
        found[down] = 2 * found[down] + (tree[level - 1][2 * found[down]] >= want[down])
        at[down] = level - 1
    return np.minimum(found, len(values))


def shared_words(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of ``lcp`` over the ranks from low + 1 to high: a sparse table, one level at a time, each answering the stretches of its size."""
    out, span = np.zeros(len(low), np.int64), high - low
    level, row = 0, lcp
    sizes = np.frexp(span.astype(np.float64))[1] - 1  # the greatest power of two that fits
    while True:
        mine = np.flatnonzero(sizes == level)
        out[mine] = np.minimum(row[low[mine] + 1], row[high[mine] + 1 - (1 << level)])
        if not (sizes > level).any():
            return out
        row = np.minimum(row[: -(1 << level)], row[1 << level :])
        level += 1


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """(sequence, start, length, period) of all runs, by sequence, start and period; ``words`` and ``doc`` as in ``Suffixes``."""
    none, need = np.zeros((0, 4), np.int64), reach(least, periods)
    all_ = Suffixes(words, doc, need)
    if not all_.kept.any():
        return none
    names, part = all_.kept_ones()
    by_place = part.lcp()
    by_rank = by_place[part.order]
    size = len(by_rank)
    up = by_place >= need
    down = np.concatenate([by_rank[1:], [0]])[part.rank] >= need
    begin, end = [], []
    for places, values in ((np.flatnonzero(up), part.rank), (np.flatnonzero(down), -part.rank)):
        begin.append(places)
        end.append(next_smaller(values, places))
    begin, end = np.concatenate(begin), np.concatenate(end)
    ok = end < size
    ok[ok] = part.doc[begin[ok]] == part.doc[end[ok]]
    begin, end = begin[ok], end[ok]
    a, b = part.rank[begin], part.rank[end]
    right, period = shared_words(by_rank, np.minimum(a, b), np.maximum(a, b)), end - begin
    ok = right >= np.maximum(least, periods * period) - 2 * period + 1
    begin, period, right = begin[ok], period[ok], right[ok]
    if not len(begin):
        return none
    left = _to_the_left(part, begin, period)
    found = np.stack([names[part.doc[begin]], begin - left - np.searchsorted(part.doc, part.doc[begin]), left + period + right, period], 1)
    found = found[found[:, 2] >= np.maximum(least, periods * found[:, 3])]
    return np.unique(found, axis=0)


def _to_the_left(part: Suffixes, begin: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Equal words before each root and before its end, in the reversed sequences of those that have a root."""
    mine = np.zeros(int(part.doc[-1]) + 1, bool)
    mine[part.doc[begin]] = True
    inside = mine[part.doc]
    move = np.cumsum(inside) - 1
    words, doc = part.words[inside], np.searchsorted(np.flatnonzero(mine), part.doc[inside])
    starts = np.searchsorted(doc, np.arange(int(doc[-1]) + 1))
    mirror = (starts + np.append(starts[1:], len(doc)) - 2)[doc] - np.arange(len(doc))  # place of the same word in the reversed sequence
    turned = words.copy()
    real = words > 0
    turned[mirror[real]] = words[real]
    back = Suffixes(turned, doc)
    lcp = back.lcp()[back.order]
    at = move[begin]
    out, some = np.zeros(len(begin), np.int64), np.flatnonzero(at > starts[doc[at]])
    a, b = back.rank[mirror[at[some] - 1]], back.rank[mirror[at[some] + period[some] - 1]]
    out[some] = shared_words(lcp, np.minimum(a, b), np.maximum(a, b))
    return out


def _step(texts: list[bytes], least: int, periods: int) -> tuple[list[list[tuple]], list[bytes]]:
    """Runs and collapsed text of each text."""
    numbers = defaultdict(count(1).__next__)
    ids, joined, names = [], [], None
    for raw in texts:
        words = raw.split()
        joined.append(b" ".join(words))
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        del words
    lens = np.array([len(x) + 1 for x in ids])
    flat = np.concatenate([y for x in ids for y in (x, [0])]).astype(np.int64)
    found = find_runs(flat, np.repeat(np.arange(len(ids)), lens), least, periods)
    runs: list[list[tuple]] = [[] for _ in texts]
    for rows in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else []:
        d = int(rows[0, 0])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1]))]
        runs[d] = rows[:, 1:].tolist()
        mark = np.zeros(len(ids[d]) + 1, np.int64)
        np.add.at(mark, rows[:, 1] + rows[:, 3], 1)
        np.add.at(mark, rows[:, 1] + rows[:, 2], -1)
        names = names or [b"", *numbers]
        joined[d] = b" ".join([names[k] for k in ids[d][np.cumsum(mark[:-1]) == 0].tolist()])
    return runs, joined


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Every row of ``docs`` with ``runs`` (array of start, length, period in words) and ``collapsed``: the words joined by
    one space, without those that a run contains after its first period. Columns of these two names are replaced."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rest = [c for c in names if c != text_col]
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    schema = plain.select("*", F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_CHARS, "right")))
                part = batch.slice(at, until - at)
                runs, collapsed = _step([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()], least, periods)
                structs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(structs, RUN), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*part.schema.names, "runs", "collapsed"])
                at = until
        give_back()

    out = plain.mapInArrow(run, schema)
    return out.select(*[F.col("t" if c == text_col else f"c{rest.index(c)}").alias(c) for c in names], "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of greatest length by period, exactly; of equal ones the first by start, then period; null without runs."""
    first = F.get(runs, 0)
    return F.aggregate(runs, first, lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with every tenth text, by the CRC-32 of its id, made periodic from a word on, as the query's contract says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), GAP, -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    later = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    turned = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), later), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every whole document after the contract's periodic edits; a null doc_id counts as empty text in the CRC."""
    rows = with_runs(planted(table(spark, sf_dir, "documents"))).withColumn("b", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
