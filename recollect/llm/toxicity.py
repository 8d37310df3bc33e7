"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of the word itself and of its beginnings of four, five and six
bytes, so that unseen endings of a known stem still carry its meaning. Filters of one, two and three words
slide over the whole text, each keeps its greatest response, and a logistic unit weighs those. Since a
filter is linear, its response is the sum of one precomputed row per word and place, so a text costs a few table look-ups per word.

Thresholds are calibrated by language on labelled rows that the training did not see; the language is read off
function words of the text itself, never off a column. A calibrated text's log odds are shifted so that
its language's threshold lies at ``CUT``; hence one cut holds for every language.

It is fitted on all labelled rows. Texts are reduced to eight bytes a word and stored; in every round each task starts from the shared weights and
goes over its rows, some at a time, and the weights' changes are averaged on executors, those of a word's embedding over the tasks that have the word.
The driver gets sums of weights, and numbers of rows by language and steps of log odds, only. Of a repeated id the smallest text and the highest label count;
null ids and labels other than 0 and 1 are left out. Null texts count as empty; an empty text is scored like any
other. Texts count whole, however long. Without labels of both classes every score is 0. Repeated rows are scored alike; of
responses that tie the first counts, and a threshold never parts scores that tie; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, forget, map_rows, per_worker, segment_sums, steps, table, words_of
from .quality_rules import COMMON

#: One in so many labelled documents calibrates the thresholds.
ASIDE = 5
#: Words of labelled texts that a training task holds at once; slices of the embeddings that are averaged side by side; units of weights and log odds in fixed point.
SEGMENT_WORDS, SLICES, FIXED, STEPS_OF_Z = 2_000_000, 16, float(1 << 28), 256
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
STEMS = (4, 5, 6)
#: Parameters of the training: passes over the sample, and the least number of minibatches, which adds passes over small samples.
EPOCHS, LEAST_STEPS, BATCH, RATE, EMBED_RATE = 6, 400, 32, 0.02, 0.2
CUT = 0.7
#: A language's own threshold needs so many calibration rows of either class; else the common one holds.
LEAST_CALIBRATION = 10
#: Words whose table rows a worker keeps before it starts anew.
KEPT_WORDS = 40_000
#: Characters, or words, of texts that are scored at once; a longer text is scored alone.
STEP, STEP_WORDS = 500_000, 80_000
STRIP = b".,;:!?\"'()[]{}*#$%&|"
PLACES = [(w, k) for w in WIDTHS for k in range(w)]
LANGS = tuple(sorted(COMMON))
#: The table of CRC-32, read off the library's.
CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
NO_MARKS = [0.0] * len(LANGS)
MARKS = {w.encode(): [float(w in COMMON[x].split()) for x in LANGS] for x in LANGS for w in COMMON[x].split()}


def buckets(word: bytes) -> list[int]:
    """Bucket of the word and of its beginnings; a short word's beginnings are the word."""
    word = word.strip(STRIP)
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS for n in STEMS)]


def many_buckets(stripped: list[bytes]) -> np.ndarray:
    """``buckets`` of many words without their marks, one row a word; checksums of beginnings go byte by byte for all words at once."""
    n, most = len(stripped), max(STEMS)
    lens = np.fromiter(map(len, stripped), np.int64, n)
    heads = np.array(stripped, f"S{most}").view(np.uint8).reshape(n, most)
    out = np.empty((n, 1 + len(STEMS)), np.int64)
    out[:, 0] = np.fromiter(map(zlib.crc32, stripped), np.int64, n)
    for j, k in enumerate(STEMS):
        crc = np.full(n, k ^ 0xFFFFFFFF, np.uint32)
        for i in range(k):
            crc = np.where(lens > i, CRC[(crc ^ heads[:, i]) & 0xFF] ^ (crc >> 8), crc)
        out[:, 1 + j] = crc ^ np.uint32(0xFFFFFFFF)
    return out % BUCKETS


class Net:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.15, (BUCKETS, DIMS)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (DIMS, len(PLACES) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-1.0)
        self.shift: dict[int, float] = {}
        self.trained = False

    def key(self) -> tuple:
        """Names the net among those that a worker may keep tables of."""
        return "net", zlib.crc32(self.embed), zlib.crc32(self.filters), self.trained

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors and their responses at every place of every filter."""
        e = self.embed[ids].sum(1)
        return e, np.einsum("nd,df->nf", e, self.filters)  # row by row: a text scores alike in any company

    def pool(self, responses: np.ndarray, at: np.ndarray, lens: np.ndarray, where: bool = False):
        """Greatest response of each filter in each text. at: the row of ``responses`` of each word, every
        text followed by three gaps (row 0, all zero), of which the first starts a window."""
        starts = np.cumsum(lens) - lens
        ends = starts + lens
        tops, args = [], []
        for i, width in enumerate(WIDTHS):
            r = None
            for k in range(width):
                p = PLACES.index((width, k)) * FILTERS
                part = np.take(responses[:, p : p + FILTERS], at[k : len(at) - 3 + k + 1], axis=0)
                r = part if r is None else np.add(r, part[: len(r)], out=r)
            r[np.concatenate([ends[:-1] - 2, ends[:-1] - 1])] = -np.inf  # those would reach into the next text
            if where:
                a = np.array([s + r[s:e].argmax(0) for s, e in zip(starts, np.minimum(ends, len(r)), strict=True)])
                args.append(a)
                tops.append(np.take_along_axis(r, a, 0))
            else:
                tops.append(np.maximum.reduceat(r, starts, axis=0))
        return np.concatenate(tops, 1), args

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled + self.bias, 0) * self.out).sum(1) + self.base


class Table:
    """Word to row of a growing table of responses; row 0 is the gap. Bounded by starting anew."""

    def __init__(self, net: Net):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = defaultdict(count(1).__next__)  # an unknown word gets the next row
        self.values = np.zeros((1, len(PLACES) * FILTERS + len(LANGS)), np.float32)
        self.used = 1

    def at(self, words: list[bytes]) -> np.ndarray:
        if self.used > KEPT_WORDS:
            self.clear()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = list(islice(self.index, self.used - 1, None))
        if new:
            need = self.used + len(new)
            if need > len(self.values):
                self.values = np.concatenate([self.values, np.zeros((max(need, 2 * len(self.values)) - len(self.values), self.values.shape[1]), np.float32)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                a = self.used + i
                stripped = [w.strip(STRIP) for w in part]
                self.values[a : a + len(part), : -len(LANGS)] = self.net.rows(many_buckets(stripped))[1]
                known = [i for i, w in enumerate(stripped) if w in MARKS]
                self.values[a : a + len(part), -len(LANGS) :] = 0
                if known:
                    self.values[a + np.array(known), -len(LANGS) :] = [MARKS[stripped[i]] for i in known]
            self.used = need
        return at


def raw_scores(net: Net, words: list[list[bytes]], rows: Table) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and language (index in LANGS, -1 without function words) of texts given as words."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = rows.at([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(words)), lens)
    at = np.zeros(len(flat) + 3 * len(words), np.int64)
    at[np.arange(len(flat)) + 3 * doc] = flat
    pooled, _ = net.pool(rows.values, at, lens + 3)
    marks = segment_sums(rows.values[flat, -len(LANGS) :], lens)
    return net.logits(pooled), np.where(marks.max(1) > 0, marks.argmax(1), -1)


def coded(texts: list[str]) -> list[bytes]:
    """Each text's words as four 16-bit buckets, after the counts of each language's function words."""
    codes: dict[bytes, bytes] = {}
    out = []
    for t in texts:
        words = words_of(t)
        new = [w for w in set(words) if w not in codes]
        raw = many_buckets([w.strip(STRIP) for w in new]).astype(np.uint16).tobytes()
        size = 2 * (1 + len(STEMS))
        codes.update((w, raw[size * i : size * i + size]) for i, w in enumerate(new))
        marks = np.sum([MARKS[w] for x in words if (w := x.strip(STRIP)) in MARKS] or [NO_MARKS], 0)
        out.append(marks.astype(np.float32).tobytes() + b"".join([codes[w] for w in words]))
    return out


class Trainer:
    """A net in training: minibatches with Adam for the dense weights and AdaGrad for the embeddings."""

    DENSE = ("filters", "bias", "out", "base")

    def __init__(self, counts: tuple[int, int]):
        """counts: rows of either class, which weigh alike in all."""
        self.net, self.t = Net(), 0.0
        self.seen = np.full((BUCKETS, 1), 1e-3, np.float32)
        self.moments = {k: [np.zeros_like(getattr(self.net, k)), np.zeros_like(getattr(self.net, k))] for k in self.DENSE}
        self.weight = np.array([sum(counts) / max(2 * c, 1) for c in counts])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """All that training changes: a row for each bucket, and one vector."""
        dense = [np.ravel(v) for k in self.DENSE for v in (getattr(self.net, k), *self.moments[k])]
        return np.concatenate([self.net.embed, self.seen], 1), np.concatenate([*dense, [self.t]]).astype(np.float32)

    def restore(self, rows: np.ndarray, dense: np.ndarray) -> None:
        self.net.embed, self.seen = rows[:, :DIMS].astype(np.float32), rows[:, DIMS:].astype(np.float32)
        at = 0
        for k in self.DENSE:
            shape = np.shape(getattr(self.net, k))
            size = int(np.prod(shape))
            parts = [dense[at + i * size : at + (i + 1) * size].astype(np.float32).reshape(shape) for i in range(3)]
            setattr(self.net, k, parts[0])
            self.moments[k] = [parts[1], np.array(np.maximum(parts[2], 0))]
            at += 3 * size
        self.t = float(dense[at])

    def learn(self, codes: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, passes: int) -> None:
        """Go over some rows. codes: rows of buckets of each text."""
        net = self.net
        lens = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.ascontiguousarray(np.concatenate(codes)).view(np.uint64).ravel()
        back, vocabulary = pd.factorize(flat)
        docs = np.split(back, np.cumsum(lens)[:-1])
        ids = vocabulary.view(np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int64)
        weight, self.slot = self.weight[y], np.zeros(len(vocabulary), np.int64)
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for b in range(0, len(docs), BATCH):
                self.step(docs, ids, y, weight, order[b : b + BATCH])
        net.trained = True

    def step(self, docs: list[np.ndarray], ids: np.ndarray, y: np.ndarray, weight: np.ndarray, pick: np.ndarray) -> None:
        net = self.net
        flat = np.concatenate([docs[i] for i in pick])
        lens = np.array([len(docs[i]) for i in pick])
        places = np.arange(len(flat))
        self.slot[flat] = places  # a word's last place tells it from its others, without sorting
        unique = flat[self.slot[flat] == places]
        self.slot[unique] = np.arange(len(unique))
        back = self.slot[flat]
        e = np.concatenate([np.zeros((1, DIMS), np.float32), net.embed[ids[unique]].sum(1)])
        r = e @ net.filters
        at = np.zeros(len(flat) + 3 * len(pick), np.int64)
        at[np.arange(len(flat)) + 3 * np.repeat(np.arange(len(pick)), lens)] = back + 1
        pooled, args = net.pool(r, at, lens + 3, where=True)
        hidden = np.maximum(pooled + net.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.base, -30, 30)))
        d = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
        dh = d[:, None] * net.out * (hidden > 0)
        grads = {"out": hidden.T @ d + 1e-4 * net.out, "base": d.sum(), "bias": dh.sum(0), "filters": np.zeros_like(net.filters)}
        touched, pulls = [], []
        for i, width in enumerate(WIDTHS):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(width):
                c = PLACES.index((width, k)) * FILTERS
                where = at[args[i] + k]
                grads["filters"][:, c : c + FILTERS] = np.einsum("nfd,nf->df", e[where], g)
                touched.append(where.ravel())
                pulls.append((g[:, :, None] * net.filters[:, c : c + FILTERS].T[None]).reshape(-1, DIMS))
        where, pull = np.concatenate(touched), np.concatenate(pulls)
        real = where > 0
        rows, back = np.unique(ids[unique[where[real] - 1]], return_inverse=True)
        back, pull = back.reshape(-1, ids.shape[1]), pull[real].ravel()
        total = sum(np.bincount((back[:, j, None] * DIMS + np.arange(DIMS)).ravel(), pull, len(rows) * DIMS) for j in range(ids.shape[1]))
        total = total.reshape(len(rows), DIMS).astype(np.float32)
        self.seen[rows] += (total**2).mean(1, keepdims=True)
        net.embed[rows] -= EMBED_RATE * total / np.sqrt(self.seen[rows])
        self.t += 1
        for k, g in grads.items():
            m, v = self.moments[k]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.99 * v + 0.01 * np.square(g)
            setattr(net, k, (getattr(net, k) - RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32))


def passes_of(rows: int) -> int:
    return max(EPOCHS, -(-LEAST_STEPS // max(1, -(-rows // BATCH))))


def train(codes: list[np.ndarray], y: np.ndarray) -> Net:
    """Fit to rows at hand."""
    trainer = Trainer(((y == 0).sum(), (y == 1).sum()))
    trainer.learn(codes, y, np.random.default_rng(5), passes_of(len(codes)))
    return trainer.net


def best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The log odds that part the classes with the greatest F1, in the middle of the gap there."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    hit = np.cumsum(w * y)
    f1 = 2 * hit / (np.cumsum(w) + (w * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no cut between ties
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def raw_coded(net: Net, codes: list[np.ndarray]) -> np.ndarray:
    """Log odds of texts given as buckets, some texts at a time so that memory follows the longest text."""
    out, part, size = [], [], 0
    for i, c in enumerate(codes):
        part.append(np.ascontiguousarray(c).view(np.uint64).ravel())
        size += len(c)
        if size < STEP_WORDS and i + 1 < len(codes):
            continue
        unique, back = np.unique(np.concatenate(part), return_inverse=True)
        rows = np.zeros((len(unique) + 1, len(PLACES) * FILTERS), np.float32)
        for a in range(0, len(unique), 20_000):
            rows[a + 1 : a + 20_001] = net.rows(unique[a : a + 20_000].view(np.uint16).reshape(-1, 1 + len(STEMS)))[1]
        lens = np.fromiter(map(len, part), np.int64, len(part))
        at = np.zeros(size + 3 * len(part), np.int64)
        at[np.arange(size) + 3 * np.repeat(np.arange(len(part)), lens)] = back + 1
        out.append(net.logits(net.pool(rows, at, lens + 3)[0]))
        part, size = [], 0
    return np.concatenate([*out, np.zeros(0, np.float32)])


def thresholds(z: np.ndarray, y: np.ndarray, lang: np.ndarray, n: np.ndarray, w: np.ndarray) -> dict[int, float]:
    """The cut of each language, by n rows each of log odds z, label y and weight w in all; -1: the common one."""
    common = best_cut(z, y, w)
    shift = {-1: common}
    for x in range(len(LANGS)):
        own = lang == x
        enough = own.any() and min(n[own & (y == c)].sum() for c in (0, 1)) >= LEAST_CALIBRATION
        shift[x] = best_cut(z[own], y[own], w[own]) if enough else common
    return shift


def uncoded(x: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of each text, and its language (index in LANGS, -1 without function words)."""
    head = 4 * len(LANGS)
    marks = np.array([np.frombuffer(c[:head], np.float32) for c in x]).reshape(-1, len(LANGS))
    return [np.frombuffer(c[head:], np.uint16).reshape(-1, 1 + len(STEMS)) for c in x], np.where(marks.max(1, initial=0) > 0, marks.argmax(1), -1)


def calibrated(rows: list[tuple[object, int, bytes]], counts: dict[int, int]) -> Net:
    """``fit`` for rows (id, label, coded text) at hand, which stand for so many of each class."""
    aside = np.array([zlib.crc32(f"calibrate {r[0]}".encode()) % ASIDE == 0 for r in rows], bool)
    y = np.array([r[1] for r in rows], np.int64)
    codes, lang = uncoded([r[2] for r in rows])
    parts = [np.flatnonzero(~aside), np.flatnonzero(aside)]
    if len(np.unique(y[parts[0]])) < 2:
        return Net()
    net = train([codes[i] for i in parts[0]], y[parts[0]])
    got = np.bincount(y, minlength=2)
    use = parts[1] if len(np.unique(y[parts[1]])) == 2 else parts[0]
    w = np.array([counts[c] / max(got[c], 1) for c in (0, 1)])[y[use]]
    net.shift = thresholds(raw_coded(net, [codes[i] for i in use]), y[use], lang[use], np.ones(len(use)), w)
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """(id, label, aside, x): every labelled document's text, coded."""
    y = F.col(label).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(y).alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(known, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    aside = F.crc32(F.concat(F.lit("calibrate "), F.col("id").cast("string"))) % ASIDE == 0
    rows = rows.select("id", "text", "label", aside.alias("aside"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(coded(texts), pa.binary())], names=["id", "label", "aside", "x"])

    return rows.mapInArrow(run, f"id {kind}, label int, aside boolean, x binary")


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(codes, labels) of some rows (id, label, x) at a time, in order of their ids."""
    rows, size = [], 0
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            rows.append(r)
            size += len(r[2]) // 8
            if size >= SEGMENT_WORDS:
                rows.sort(key=lambda r: str(r[0]))
                yield uncoded([r[2] for r in rows])[0], np.array([r[1] for r in rows])
                rows, size = [], 0
    if rows:
        rows.sort(key=lambda r: str(r[0]))
        yield uncoded([r[2] for r in rows])[0], np.array([r[1] for r in rows])


def one_round(rows: DataFrame, trainer: Trainer, number: int, passes: int) -> None:
    """All rows (id, label, x) are gone over by tasks that start from the trainer's state, which then gets the mean of their changes."""
    rows_after, dense_after = (x.astype(np.float64) for x in trainer.state())
    width = len(dense_after)
    edges = np.linspace(0, BUCKETS, SLICES + 1).astype(int)
    schema = "slice int, n long, z binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        before, rng, n = trainer.state(), np.random.default_rng([5, number]), 0
        for codes, y in segments(batches):
            trainer.learn(codes, y, rng, passes)
            n += len(y)
        if n:
            change, flat = (x - y for x, y in zip(trainer.state(), before, strict=True))
            parts = [*np.split(change, edges[1:-1]), flat]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts)), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["slice", "n", "z"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, z in zip(*[c.to_pylist() for c in b.columns], strict=True):
                z = np.frombuffer(z, np.float32).reshape(-1, width if k == SLICES else DIMS + 1)
                own = sums.setdefault(k, [np.zeros(z.shape, np.int64), np.zeros((len(z), 1), np.int64)])  # whole numbers: their order does not matter
                own[0] += n * np.rint(z.astype(np.float64) * FIXED).astype(np.int64)
                own[1] += n * (z != 0).any(1, keepdims=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int64()), pa.array([(a / FIXED / np.maximum(n, 1)).tobytes() for a, n in sums.values()], pa.binary())], names=["slice", "n", "z"])

    for r in rows.mapInArrow(run, schema).repartition(SLICES + 1, "slice").mapInArrow(mean, schema).collect():
        z = np.frombuffer(r["z"], np.float64)
        if r["slice"] == SLICES:
            dense_after += z
        else:
            rows_after[edges[r["slice"]] : edges[r["slice"] + 1]] += z.reshape(-1, DIMS + 1)
    trainer.restore(rows_after, dense_after)


def log_odds(rows: DataFrame, net: Net) -> DataFrame:
    """(lang, z, label, n): how many rows (id, label, x) of a language and label have log odds that round to z / ``STEPS_OF_Z``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            codes, lang = uncoded(b.column(2).to_pylist())
            z = np.rint(np.clip(raw_coded(net, codes), -1000, 1000) * STEPS_OF_Z).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(z), b.column(1)], names=["lang", "z", "label"])

    return rows.mapInArrow(run, "lang int, z int, label int").groupBy("lang", "z", "label").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Net:
    """Train on all labelled rows but those aside, and set each language's threshold by these."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    try:
        rows = scratch.keep(labelled(docs, labels, label, id_col, text_col), "coded")
        counts = {(r["aside"], r["label"]): r["count"] for r in rows.groupBy("aside", "label").count().collect()}
        own = counts.get((False, 0), 0), counts.get((False, 1), 0)
        if not all(own):
            return Net()
        trainer = Trainer(own)
        for k in range(EPOCHS):
            one_round(rows.where("NOT aside").select("id", "label", "x"), trainer, k, -(-passes_of(sum(own)) // EPOCHS))
        net, use = trainer.net, "aside" if all(counts.get((True, c)) for c in (0, 1)) else "NOT aside"
        net.trained = True
        got = log_odds(rows.where(use).select("id", "label", "x"), net).orderBy("lang", "z", "label").collect()
        lang, z, y, n = np.array(got, np.int64).reshape(-1, 4).T
        net.shift = thresholds(z / STEPS_OF_Z, y, lang, n, n.astype(float))
        return net
    finally:
        scratch.close()


def scores(net: Net, texts: list[str], rows: Table) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated scores and languages."""
    if not net.trained:
        return np.zeros(len(texts)), np.full(len(texts), -1)
    z, lang = raw_scores(net, [words_of(t) for t in texts], rows)
    z = z - np.array([net.shift[x] for x in lang]) + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500))), lang


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, language read off the text), one row per row."""
    kind, key = docs.schema[id_col].dataType.simpleString(), net.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = per_worker(key, lambda: Table(net))
        for batch, texts in steps(batches, limit=STEP):
            p, lang = scores(net, texts, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array([None if x < 0 else LANGS[x] for x in lang], pa.string())], names=[id_col, "score", "text_lang"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, text_lang string")


def accepted(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """The rows below the cut, with all columns."""

    at, key = docs.columns.index(text_col), net.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = per_worker(key, lambda: Table(net))
        for part, texts in steps(batches, text=at, limit=STEP):
            yield part.filter(pa.array(scores(net, texts, rows)[0] < CUT))

    return map_rows(docs, run)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    net = fit(docs, labels.where(~held))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "text_lang")
