"""Language-model scoring by Katz backoff over word n-grams, of any order from two on.

P(w | h) = d(c(hw)) c(hw) / c(h) where the n-gram was seen, else a(h) P(w | h'), h' being h without its first word;
P(w) = d(c(w)) c(w) / N, and the mass that discounting frees is the unknown word's. d are Good-Turing discounts, from
the counts of counts of each order; a(h) is the exact remainder, so that P(. | h) sums to one for every history. A
history that was never seen backs off whole; every text starts from start marks and finishes with an end token.

Token-level rows are never shuffled. Texts become segments of one or two million tokens with a vocabulary of
their own, kept as packed arrays. A segment asks for each of its distinct n-grams once, in sorted packed blocks
by hash bucket; a bucket sums what all segments bring and answers with the total counts. The sums are the model, a table
partitioned by part and order, in files by bucket (``ngrams``). Of the segments that hold a seen n-gram the first owns it;
order by order, owners add up each history's seen mass under both orders, which one more exchange turns into backoff weights
(``backoff``). Then each segment evaluates its n-grams by recursion over the orders, in array look-ups. Keys are spread by
hash and each segment brings a key once, so that frequent words and frequent histories load no task more than others.

Null and empty texts have the end token only. Repeated rows count each time. Null ids count as the empty
text for the split. Without training texts every token is unknown with probability one. An empty table gives an empty
result; other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, give_back, mix, steps, table, word_hashes
from .packed import bucket_edges, pack, pack_sorted, unpack, unpack_sorted

#: Tokens of a segment, and keys of a bucket, about. Larger segments ask for fewer keys and take more memory.
SEGMENT, BUCKET = 1_600_000, 1_000_000
#: Counts up to this are discounted by Good-Turing.
GT = 5
#: Words of an n-gram. Each order more is another set of keys and answers in the shared folder.
ORDER = 2
END, START = np.uint64(1), np.uint64(2)


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0..GT) from the numbers of n-grams seen once, twice, .. GT + 1 times.

    Where Good-Turing gives no value strictly between 0 and 1, absolute discounting stands in.
    """
    n = np.concatenate([[0.0], np.asarray(counts, np.float64)])
    d = np.ones(GT + 1)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = turing if 0 < turing < 1 else (r - absolute) / r
    return d


def segments(df: DataFrame) -> DataFrame:
    """(seg, ids, lens, train, vocab, tokens, n): packed texts. df: (id, text, held)."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 24
        ids, train, lens, flat, size = [], [], [], [], 0

        def flush():
            vocab, tokens = np.unique(np.concatenate(flat), return_inverse=True)
            n = np.array(lens, np.int32)
            row = [pa.array([seg]), pa.array([ids], pa.list_(batch.schema.field(0).type)), pa.array([pack(n)]), pa.array([pack(np.array(train, np.uint8))]), pa.array([pack_sorted(vocab)]), pa.array([pack(tokens.astype(np.uint32))]), pa.array([int(n.sum())]), pa.array([len(vocab)])]
            return pa.RecordBatch.from_arrays(row, names=["seg", "ids", "lens", "train", "vocab", "tokens", "n", "v"])

        for batch, texts in steps(batches):
            hashes, sizes = word_hashes(texts)
            hashes[hashes <= START] += np.uint64(3)  # two values are marks
            for i, held, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), np.split(hashes, np.cumsum(sizes)[:-1]), strict=True):
                ids.append(i)
                train.append(not held)
                lens.append(len(h) + 1)
                flat += [h, np.array([END], np.uint64)]
                size += len(h) + 1
                if size >= SEGMENT:
                    yield flush()
                    seg += 1
                    ids, train, lens, flat, size = [], [], [], [], 0
        if ids:
            yield flush()

    return df.select("id", "text", "held").mapInArrow(run, f"seg long, ids array<{kind}>, lens binary, train binary, vocab binary, tokens binary, n long, v long")


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each comes first, and each value's place among them: ``np.unique`` with fewer arrays at a time."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    codes, first = codes[new], order[new].astype(np.int32)
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes, first, back


def freed(batches: Iterator[pa.RecordBatch], one) -> Iterator[pa.RecordBatch]:
    """What ``one(row, schema)`` yields for each row of some batches. A row's arrays are gone before the next row's are made, and an idle worker keeps none."""
    for b in batches:
        for r in b.to_pylist():
            yield from one(r, b.schema)
            r = None
            give_back()


class Segment:
    """A segment's n-grams up to an order. Per order k: distinct keys in their order (``keys``), each token's n-gram (``back``), and of
    each n-gram its training count (``times``), its history (``history``: a place in ``names``) and what is left of it
    without its first word (``shorter``: an n-gram of order k - 1). Histories of order k are the n-grams of order k - 1, and a start mark.
    Places are 32-bit, as a segment has fewer tokens than that."""

    def __init__(self, row: dict, order: int):
        self.lens = unpack(row["lens"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(unpack(row["train"], np.uint8).astype(bool), self.lens)
        self.keys, self.back = {1: unpack_sorted(row["vocab"])}, {1: unpack(row["tokens"], np.int32)}
        self.times, self.history, self.shorter, self.names = {1: self.counted(1)}, {}, {}, {}
        for k in range(2, order + 1):
            self.extend(k)

    def counted(self, k: int) -> np.ndarray:
        return np.bincount(self.back[k][self.train], minlength=len(self.keys[k]))

    def extend(self, k: int) -> None:
        vocab, tokens, last = self.keys[1], self.back[1], self.back[k - 1]
        names = np.append(self.keys[k - 1], START)
        codes = np.zeros(len(last), np.int64)
        codes[1:] = last[:-1]
        codes[self.starts] = len(names) - 1
        codes *= len(vocab)
        codes += tokens
        codes, first, back = distinct(codes)
        history, word = (codes // len(vocab)).astype(np.int32), (codes % len(vocab)).astype(np.int32)
        del codes
        with np.errstate(over="ignore"):
            keys = mix(mix(names[history]) * np.uint64(0x9E3779B97F4A7C15) + vocab[word])
        del word
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.keys[k], self.back[k], self.names[k] = keys[order], place[back], names
        self.history[k], self.shorter[k] = history[order], last[first[order]]
        self.times[k] = self.counted(k)

    def by_name(self, k: int) -> np.ndarray:
        """The order in which histories are asked for and answered."""
        return np.argsort(self.names[k], kind="stable")


PARTS = ["seg", "lens", "train", "vocab", "tokens"]
ASK = "kind int, bucket long, seg long, keys binary, a binary, b binary, c binary"


def ask(kind: int, seg: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    edges = bucket_edges(keys, buckets)
    full = np.flatnonzero(np.diff(edges))
    cut = [(edges[i], edges[i + 1]) for i in full]
    columns = [pa.array([pack(v[s:e]) for s, e in cut], pa.binary()) for v in values]
    columns += [pa.nulls(len(full), pa.binary())] * (3 - len(values))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(full), pa.array(np.full(len(full), seg)), pa.array([pack_sorted(keys[s:e]) for s, e in cut], pa.binary()), *columns], names=["kind", "bucket", "seg", "keys", "a", "b", "c"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """All requests of one bucket at a time, of input that is sorted by kind and bucket."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["kind"], r["bucket"]) != key:
                if rows:
                    yield *key, rows
                key, rows = (r["kind"], r["bucket"]), []
            rows.append(r)
    if rows:
        yield *key, rows
    rows = b = r = None
    give_back()


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, index of each request's keys among them, where each request starts)."""
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, back, np.concatenate([[0], np.cumsum([len(k) for k in keys])])


ANSWER = "kind int, bucket long, seg long, keys binary, a binary, b binary, stats array<long>, part string"


def answers(kind: int, bucket: int, rows: list[dict], cut: np.ndarray, a: np.ndarray, b: np.ndarray, model: tuple, stats) -> pa.RecordBatch:
    """A row for each segment that asked, and one of the model's part, with seg null."""
    parts = list(zip(cut[:-1], cut[1:], strict=True))
    n = len(rows) + 1
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket)), pa.array([*[r["seg"] for r in rows], None], pa.int64()),
        pa.array([*[None] * len(rows), pack_sorted(model[0])], pa.binary()), pa.array([*[pack(a[s:e]) for s, e in parts], pack(model[1])], pa.binary()),
        pa.array([*[pack(b[s:e]) for s, e in parts], pack(model[2])], pa.binary()), pa.array([*[None] * len(rows), stats], pa.list_(pa.int64())), pa.array([*["answer"] * len(rows), "model"]),
    ], names=["kind", "bucket", "seg", "keys", "a", "b", "stats", "part"])


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answer with total training counts (a) and with who owns a key (b): the first segment that trains on it."""
    for kind, bucket, rows in by_bucket(batches):
        rows.sort(key=lambda r: r["seg"])
        keys, back, cut = merged(rows)
        own = np.concatenate([unpack(r["a"], np.int64) for r in rows])
        total = np.bincount(back, weights=own, minlength=len(keys)).astype(np.int64)
        first = np.full(len(keys), len(back))
        trains = np.flatnonzero(own)
        np.minimum.at(first, back[trains], trains)
        seen = total > 0
        stats = [int(total.sum()), int(seen.sum()), *(int((total == r).sum()) for r in range(1, GT + 2))]
        yield answers(kind, bucket, rows, cut, total[back], (first[back] == np.arange(len(back))).astype(np.uint8), (keys[seen], total[seen], np.zeros(0, np.uint8)), stats)


def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answer with log10 of the backoff weight (a) and the denominator (b) of each history."""
    for kind, bucket, rows in by_bucket(batches):
        rows.sort(key=lambda r: r["seg"])
        keys, back, cut = merged(rows)
        count, mass, lower = (np.bincount(back, weights=np.concatenate([unpack(r[x], np.float64) for r in rows]), minlength=len(keys)) for x in "abc")
        # a history whose followers are all too frequent to be discounted leaves one count to the others
        below = count + (mass >= count * (1 - 1e-12))
        left = np.where(count > 0, 1 - mass / np.maximum(below, 1), 1.0)
        log = np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))
        log[count == 0] = 0.0
        known = count > 0
        yield answers(kind, bucket, rows, cut, log[back], below[back], (keys[known], log[known], below[known]), None)


def exchanged(asks: DataFrame, answer) -> DataFrame:
    return asks.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(answer, ANSWER)


def stats_of(table: DataFrame, order: int) -> dict[int, np.ndarray]:
    rows = table.where("part = 'model'").select("kind", F.posexplode("stats").alias("i", "x")).groupBy("kind", "i").agg(F.sum("x").alias("x")).collect()
    out = {k: np.zeros(2 + GT + 1) for k in range(1, order + 1)}
    for r in rows:
        out[r["kind"]][r["i"]] = r["x"]
    return out


class Params:
    """What all tokens need: totals, discounts by order, and the unknown word's share."""

    def __init__(self, stats: dict[int, np.ndarray]):
        one = stats[1]
        self.n, self.v = float(one[0]), float(one[1])
        self.d = {k: discounts(x[2:]) for k, x in stats.items()}
        freed = sum(one[1 + r] * r * (1 - self.d[1][r]) for r in range(1, GT + 1))
        self.below = self.n + (freed <= 0)  # nothing freed: one count more in the denominator
        self.unknown = (freed + (freed <= 0)) / max(self.below, 1.0) if self.n else 1.0

    def discounted(self, c: np.ndarray, k: int) -> np.ndarray:
        return c * np.where(c <= GT, self.d[k][np.minimum(c, GT)], 1.0)

    def probability(self, s: Segment, row: dict, k: int) -> np.ndarray:
        """P of the last word of each of the segment's n-grams of order k, from the answers in row."""
        c = joined(row[f"c{k}"], "a", np.int64)
        if k == 1:
            return np.where(c > 0, self.discounted(c, 1) / max(self.below, 1.0), self.unknown)
        order = s.by_name(k)
        weight, below = np.empty(len(order)), np.empty(len(order))
        weight[order], below[order] = 10 ** joined(row[f"h{k}"], "a", np.float64), joined(row[f"h{k}"], "b", np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = self.discounted(c, k) / below[s.history[k]]
        return np.where(c > 0, seen, weight[s.history[k]] * self.probability(s, row, k - 1)[s.shorter[k]])


def answered(segs: DataFrame, ngrams: DataFrame, order: int, backoffs: dict[int, DataFrame]) -> DataFrame:
    """Segments with the answers to them, in bucket order, as arrays c1, c2, .. (counts) and h2, h3, .. (histories) by order."""
    out = segs
    for t, name, kinds in [(ngrams, "c", range(1, order + 1)), *((t, "h", [k]) for k, t in backoffs.items())]:
        rows = t.where((F.col("part") == "answer") & F.col("kind").isin(*kinds))
        got = rows.groupBy("seg").pivot("kind", list(kinds)).agg(F.array_sort(F.collect_list(F.struct("bucket", "a", "b"))))
        out = out.join(got.withColumnsRenamed({str(k): f"{name}{k}" for k in kinds}), "seg")
    return out


def joined(rows: list[dict], field: str, dtype) -> np.ndarray:
    return np.concatenate([unpack(r[field], dtype) for r in rows] or [np.zeros(0, dtype)])


def fit_and_score(docs: DataFrame, held, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Scores of all rows under a model of those where ``held`` is false, and the model's tables.

    Scores: (id, held_out, n_tokens, n_known, train_tokens, base_score, score). Model: ``ngrams`` (kind: the
    order; bucket, packed sorted key hashes, counts) and ``backoff`` (kind: the order that the histories are for; packed histories, log10
    weights, denominators).
    """
    if order < 2:
        raise ValueError("a backoff model has an order of two or more")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held"))
    kind = rows.schema["id"].dataType.simpleString()
    segs = scratch.keep(segments(rows), "segments")
    total = segs.agg(F.sum("v"), F.sum("n")).first()
    buckets = {k: max(1, -(-(total[k > 1] or 0) // BUCKET)) for k in range(1, order + 1)}

    def count(r: dict, _: pa.Schema) -> Iterator[pa.RecordBatch]:
        s = Segment(r, 1)
        for k in buckets:
            if k > 1:
                s.extend(k)
            yield ask(k, r["seg"], buckets[k], s.keys[k], s.times[k])

    ngrams = scratch.keep(exchanged(segs.select(*PARTS).mapInArrow(lambda x: freed(x, count), ASK), totals), "ngrams", by=("part", "kind"))
    p = Params(stats_of(ngrams, order))

    def masses(k: int):
        def one(r: dict, _: pa.Schema) -> Iterator[pa.RecordBatch]:
            s = Segment(r, k)
            c, own = joined(r[f"c{k}"], "a", np.int64), joined(r[f"c{k}"], "b", np.uint8) > 0
            lower = p.probability(s, r, k - 1)[s.shorter[k][own]]
            sums = [np.bincount(s.history[k][own], weights=x, minlength=len(s.names[k])) for x in (c[own], p.discounted(c[own], k), lower)]
            at = s.by_name(k)
            yield ask(k, r["seg"], buckets[k - 1], s.names[k][at], *(x[at] for x in sums))

        return lambda batches: freed(batches, one)

    backoffs: dict[int, DataFrame] = {}
    for k in range(2, order + 1):
        asks = answered(segs.select(*PARTS), ngrams, k, backoffs).mapInArrow(masses(k), ASK)
        backoffs[k] = scratch.keep(exchanged(asks, weights), f"backoff{k}", by=("part", "kind"))

    def evaluate(r: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        s = Segment(r, order)
        score = np.log10(p.probability(s, r, order))
        c = joined(r["c1"], "a", np.int64)
        base = np.log10((c + 0.5) / (p.n + 0.5 * (p.v + 1)))
        sums = [np.add.reduceat(x, s.starts) for x in ((c > 0)[s.back[1]].astype(np.int64), base[s.back[1]], score[s.back[order]])]
        yield pa.RecordBatch.from_arrays([pa.array(r["ids"], schema.field("ids").type.value_type), pa.array(~s.train[s.starts]), pa.array(s.lens), pa.array(sums[0]), pa.array(np.full(len(s.lens), int(p.n))), pa.array(sums[1]), pa.array(sums[2])], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = answered(segs.select("ids", *PARTS), ngrams, order, backoffs).mapInArrow(lambda x: freed(x, evaluate), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    known = [t.where("part = 'model'").select("kind", "bucket", "keys", "a", "b") for t in backoffs.values()]
    return out.withColumnRenamed("id", id_col), {"ngrams": ngrams.where("part = 'model'").select("kind", "bucket", "keys", "a"), "backoff": functools.reduce(DataFrame.unionAll, known)}


def op4_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1, Scratch(spark, "katz-lm"))[0]
