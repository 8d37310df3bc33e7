"""Benchmark decontamination by latent semantic retrieval.

1. All documents are cut into passages, of which the benchmark's words and their numbers are kept; their document frequencies are summed.
2. TF-IDF vectors of all passages and of all items go through a randomised SVD: a random range is sharpened by a
   power step, and Nystroem's formula gives the latent space after one more; each is a sum of small matrices over all tasks.
3. Every window of every text is put into that space and compared with all items of its scale by cosine, as matrix products. Windows come in
   scales, each twice the one before, and each item meets the scale that surely holds it whole. Items of ``LEAST_COSINE`` or more are candidates.
   Beside them stand windows that hold ``HITS`` of an item's rarest two fifths and ``HITS`` more words: a subsequence of ``LEAST_LCS`` leaves out at most two words in
   five, so none of those is lost, whatever its cosine.
4. A candidate counts when the longest common subsequence of words covers ``LEAST_LCS`` of the item, or ``NEAR_LCS`` where the cosine brought it, and the answer, the
   item's last words, is among them; nearly whole copies need no answer check. So a paraphrase that keeps the telling words and
   replaces up to half of all is found by its cosine only.

Words are runs of letters and digits, lower-cased, so case, punctuation and line breaks do not matter; in scripts written without
spaces every character is a word. An item of fewer than ``LEAST_WORDS`` words is too short for latent retrieval and
counts where a text holds all its words in a row. Null and empty texts and items find nothing; texts count whole, however long;
repeated texts are found each, repeated items once; rows with a null id are found under a null id; of windows that tie the greatest cosine is
told. An empty table gives an empty result; other columns are not read. Items are broadcast in blocks of bounded size, as many blocks as needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget, map_rows, mix, steps, table, word_hashes

#: Items and characters of items that one block, with its vocabulary and latent space, may hold, about; blocks searched by one task.
BLOCK, BLOCK_CHARS, BLOCKS_AT_ONCE = 2000, 400_000, 4
LEAST_WORDS = 5
#: Passages for statistics and the SVD, in words; documents of ``sampled``, and passages of one.
PASSAGE, SAMPLE_DOCS, SAMPLE_PASSAGES = 64, 2000, 16
RANK, EXTRA, POWER_STEPS = 96, 10, 1
#: An item is so many times as long as a passage in the SVD; its square grows with the passages beyond so many, so that the space does not depend on the size of the table.
ITEM_WEIGHT, WEIGHED_AT = 3.0, 2000
#: Words of dense products, rows of a product, parts of a matrix that are added side by side, and units of one in fixed point.
COMMON, ROWS, SLICES, FIXED = 512, 1000, 16, float(1 << 20)
FIRST_WINDOW = 32
#: Pairs of this cosine are candidates, and count from a shorter common subsequence on than those of rare words alone.
LEAST_COSINE, NEAR_LCS = 0.7, 0.5
LEAST_LCS, SURE_LCS, LEAST_ANSWER = 0.6, 0.8, 0.5
#: Windows, or blocks of words, of one matrix product.
WINDOWS = 8192
#: Of an item's rarest words, so many must lie in a window before it is searched.
HITS = 4
STEP = 1_000_000
#: ASCII letters and digits and the bytes of other characters stay; the rest parts words.
KEEP = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
#: Thai, Lao, Burmese, Khmer, Japanese and Chinese characters are words; other marks and spaces beyond ASCII part words.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])|[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    return word_hashes([t if t.isascii() else UNSPACED.sub(lambda m: f" {m[0]} " if m[1] else " ", t) for t in low], KEEP)


def in_a_row(h: np.ndarray, n: int) -> np.ndarray:
    """A key of each n words in a row."""
    with np.errstate(over="ignore"):
        key = np.full(max(len(h) - n + 1, 0), n, np.uint64)
        for k in range(n):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return key


class Items:
    """A block of benchmark items and, once fitted, its weights and latent space."""

    def __init__(self, rows: list[tuple[object, str]]):
        rows = [(i, t) for i, t in rows if t]
        h, lens = words([t for _, t in rows])
        cut = np.split(h, np.cumsum(lens)[:-1]) if len(rows) else []
        keep = [k for k in range(len(rows)) if lens[k] >= LEAST_WORDS]
        few = [k for k in range(len(rows)) if 0 < lens[k] < LEAST_WORDS]
        self.ids = [rows[k][0] for k in keep + few]
        self.short = {n: {} for n in range(1, LEAST_WORDS)}  # words in a row -> items
        for i, k in enumerate(few):
            self.short[int(lens[k])].setdefault(int(in_a_row(cut[k], int(lens[k]))[0]), []).append(len(keep) + i)
        self.vocab = np.unique(np.concatenate([cut[k] for k in keep])) if keep else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocab, cut[k]) for k in keep]
        self.size = np.array([len(w) for w in self.words], np.int64)
        window = np.maximum(FIRST_WINDOW, 2 ** np.ceil(np.log2(np.maximum(self.size, 1) * 4 / 3)).astype(np.int64))
        self.scales = [(int(w), np.flatnonzero(window == w)) for w in np.unique(window)]

    def index(self, h: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary, -1 for others."""
        at = np.searchsorted(self.vocab, h).clip(max=max(len(self.vocab) - 1, 0))
        return np.where(self.vocab[at] == h, at, -1) if len(self.vocab) else np.full(len(h), -1)

    def weigh(self, df: np.ndarray, total: float) -> None:
        self.idf = np.log((1 + total) / (1 + df)) + 0.1
        self.weight = ITEM_WEIGHT * max(1.0, total / WEIGHED_AT) ** 0.5
        # a subsequence of the least length leaves out so few words that it has HITS among the rarest of an item
        word, item, self.need = [], [], np.zeros(len(self.words), np.int64)
        for i, w in enumerate(self.words):
            least = int(np.ceil(LEAST_LCS * len(w) - 1e-9))
            self.need[i] = min(HITS, least)
            rare = np.unique(w[np.argsort(-self.idf[w], kind="stable")[: len(w) - least + self.need[i]]])
            word.append(rare)
            item.append(np.full(len(rare), i))
        word, item = np.concatenate([*word, np.zeros(0, np.int64)]), np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(word, kind="stable")
        self.posting, self.edge = item[order], np.searchsorted(word[order], np.arange(len(self.vocab) + 1))
        self.span = np.zeros(len(self.words), np.int64)
        for length, own in self.scales:
            self.span[own] = length + 2 * (length // 4)

    def hits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first place, last place) of runs of as many of an item's rarest words as it needs."""
        place = np.flatnonzero(at >= 0)
        many = np.diff(self.edge)[at[place]]
        slot = np.repeat(self.edge[at[place]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        item, place = np.divmod(np.sort(self.posting[slot] * len(at) + np.repeat(place, many)), max(len(at), 1))
        last = np.arange(len(item)) + self.need[item] - 1
        ok = np.flatnonzero(last < len(item))
        ok = ok[(item[last[ok]] == item[ok]) & (place[last[ok]] - place[ok] < self.span[item[ok]])]
        return item[ok], place[ok], place[last[ok]]

    def place(self, basis: np.ndarray) -> None:
        self.basis = (basis * self.idf[:, None]).astype(np.float32)
        self.latent = unit(np.array([self.basis[w].sum(0) for w in self.words], np.float32).reshape(len(self.words), -1))
        self.masks, self.answers = [], []
        for w in self.words:
            tail = w[-max(3, len(w) // 4) :]
            self.masks.append(bit_masks(w))
            self.answers.append((bit_masks(tail), len(tail)))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def bit_masks(seq) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(seq.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def lcs(masks: dict[int, int], size: int, seq: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    full = (1 << size) - 1
    v = full
    for w in seq:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def passages(lens: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows of texts laid end to end; a short text is one window."""
    n = np.where(lens > 0, np.maximum(1, -(-(lens - length) // stride) + 1), 0)
    text = np.repeat(np.arange(len(lens)), n)
    first = np.cumsum(lens) - lens
    start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
    return text, start, np.minimum(start + length, (first + lens)[text])


def passage_words(texts: DataFrame, items: Items, most: int | None = None) -> DataFrame:
    """(word binary, tf binary, n binary), one row a text: for its passages, or ``most`` of them spread evenly, places of the vocabulary's words that
    occur (uint32), how often each does (uint8), and how many words each passage has so (uint8)."""
    size = len(items.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for _, part in steps(batches, text=0):
            h, lens = words(part)
            at = items.index(h)
            text, start, end = passages(lens, PASSAGE, PASSAGE)
            if most and len(text):
                many = np.bincount(text, minlength=len(part))[text]
                even = (np.arange(len(text)) - np.searchsorted(text, text)) * most // np.maximum(many, most)
                take = np.concatenate([[True], (even[1:] != even[:-1]) | (text[1:] != text[:-1])])
                at = at[np.repeat(take, end - start)]
                text, start, end = text[take], start[take], end[take]
            pair, tf = np.unique((np.repeat(np.arange(len(text)), end - start) * size + at)[at >= 0], return_counts=True)  # with counts it sorts, which is faster
            passage, word = np.divmod(pair, max(size, 1))
            ends = np.searchsorted(text[passage], np.arange(len(part)), "right"), np.searchsorted(text, np.arange(len(part)), "right")
            n = np.bincount(passage, minlength=len(text))
            yield pa.RecordBatch.from_arrays([binaries(word.astype(np.uint32), ends[0]), binaries(tf.astype(np.uint8), ends[0]), binaries(n.astype(np.uint8), ends[1])], names=["word", "tf", "n"])

    return texts.mapInArrow(run, "word binary, tf binary, n binary")


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values, up to each of the ends, as binary values."""
    at = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def word_counts(rows: DataFrame, items: Items) -> tuple[np.ndarray, float]:
    """In how many passages of ``passage_words`` each word of the vocabulary occurs, and of how many."""
    size = len(items.vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32), minlength=size)
            n += sum(map(len, b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(df, n))], names=["i", "n"])

    out = np.zeros(size + 1)
    for r in rows.select("word", "n").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out[:-1], out[-1]


def frequencies(texts: DataFrame, items: Items) -> tuple[np.ndarray, float]:
    """In how many passages of all texts each word of the vocabulary occurs, and of how many."""
    return word_counts(passage_words(texts, items), items)


def sampled(docs: DataFrame, total: int, items: Items) -> DataFrame:
    """``passage_words`` of about ``SAMPLE_DOCS`` different texts of ``total`` rows, picked by a hash of the text: for a caller that wants a
    smaller fit. The operators fit on the passages of all texts."""
    key = F.xxhash64("text")
    some = docs.where(F.col("text").isNotNull() & (F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / max(total, 1)))))
    some = some.groupBy(key.alias("key")).agg(F.first("text").alias("text"))
    return passage_words(some.select("text"), items, SAMPLE_PASSAGES)


def run_sums(rows: np.ndarray, at: np.ndarray, first: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``rows[at] * x`` over runs that begin at ``first``: first rows of all runs, then second ones of those that have them, and so on."""
    lens = np.diff(np.append(first, len(at)))
    order = np.argsort(-lens, kind="stable")
    many = len(lens) - np.searchsorted(lens[order[::-1]], np.arange(lens[order[0]]) if len(lens) else [], "right")
    out, first = np.zeros((len(lens), rows.shape[1]), rows.dtype), first[order]
    for k, m in enumerate(many.tolist()):
        part = rows[at[first[:m] + k]]
        out[:m] += part if x is None else np.multiply(part, x[first[:m] + k, None], out=part)
    back = np.empty_like(out)
    back[order] = out
    return back


class Gram:
    """Sums of A'(A q) over sparse rows A, many rows at a time. The ``COMMON`` most frequent words, which make most of the rows, go through dense products."""

    def __init__(self, idf: np.ndarray, q: np.ndarray):
        self.idf, self.q = idf, np.ascontiguousarray(q, np.float32)
        self.common = np.argsort(idf, kind="stable")[:COMMON]
        self.column = np.full(len(idf), -1)
        self.column[self.common] = np.arange(len(self.common))
        self.head, self.dense, self.out = self.q[self.common], np.zeros((len(self.common), q.shape[1]), np.float32), np.zeros(q.shape, np.float32)

    def add(self, word: np.ndarray, tf: np.ndarray, n: np.ndarray, weight: float = 1.0) -> None:
        """Rows of n words each, with their number in the row; a row's TF-IDF is of length ``weight``."""
        n = n[n > 0].astype(np.int64)
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(n)), n)
        x = tf * self.idf[word]
        x = (x * (weight / np.sqrt(np.bincount(row, x * x)))[row]).astype(np.float32)
        for a in range(0, len(n), ROWS):
            part = slice(ends[a] - n[a], ends[min(a + ROWS, len(n)) - 1])
            self.step(word[part], x[part], row[part] - a, min(ROWS, len(n) - a))

    def step(self, word: np.ndarray, x: np.ndarray, row: np.ndarray, rows: int) -> None:
        column = self.column[word]
        often = column >= 0
        a = np.zeros((rows, len(self.common)), np.float32)
        a[row[often], column[often]] = x[often]
        y = a @ self.head
        word, x, row = word[~often], x[~often], row[~often]
        if len(word):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            y[row[first]] += run_sums(self.q, word, first, x)
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.diff(word[order], prepend=-1))
            self.out[word[order[first]]] += run_sums(y, row[order], first, x[order])
        self.dense += a.T @ y

    def total(self) -> np.ndarray:
        self.out[self.common] += self.dense
        self.dense[:] = 0
        return self.out


def latent_basis(rows: DataFrame, items: Items) -> np.ndarray:
    """The leading right singular vectors of ``passage_words`` and items, one row per word of the vocabulary.

    Every task sums its passages into one small matrix; slices of these are added on executors, in fixed point, so that their order does not matter.
    The last pass gives the space by Nystroem's formula.
    """
    own = [np.unique(w, return_counts=True) for w in items.words]
    own = [np.concatenate([u for u, _ in own]), np.concatenate([tf for _, tf in own]), np.array([len(u) for u, _ in own])]
    size, idf = len(items.vocab), items.idf
    edges = np.linspace(0, size, min(size, SLICES) + 1).astype(int)

    def times(q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            gram = Gram(idf, q)
            for b in batches:
                gram.add(*(np.frombuffer(b"".join(c.to_pylist()), t) for c, t in zip(b.columns, (np.uint32, np.uint8, np.uint8), strict=True)))
            fixed = np.rint(gram.total().astype(np.float64) * FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(edges) - 1), pa.int32()), pa.array([fixed[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["slice", "z"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(z, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([z.tobytes() for z in sums.values()], pa.binary())], names=["slice", "z"])

        gram = Gram(idf, q)
        gram.add(*own, items.weight)
        z = gram.total().astype(np.float64)
        schema = "slice int, z binary"
        for r in rows.mapInArrow(run, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect():
            a, b = edges[r["slice"] : r["slice"] + 2]
            z[a:b] += np.frombuffer(r["z"], np.int64).reshape(b - a, -1) / FIXED
        return z

    q = np.random.default_rng(3).normal(size=(size, min(size, RANK + EXTRA)))
    for _ in range(POWER_STEPS):
        q, _ = np.linalg.qr(times(q))
    q, _ = np.linalg.qr(q)
    z = times(q)
    value, vector = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    good = value > 1e-6 * value[-1]
    return np.linalg.svd(z @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)[0][:, :RANK]


def matches(items: Items, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, share of the item in the common subsequence, share of its answer) of contaminated texts."""
    h, lens = words(texts)
    first = np.cumsum(lens) - lens
    best: dict[tuple[int, int], tuple] = {}
    for n, own in items.short.items():
        if own:
            key = in_a_row(h, n)
            at = np.flatnonzero(np.isin(key, np.fromiter(own, np.uint64, len(own))))
            text = np.searchsorted(first + lens, at, "right")  # the text that holds the first word; the last must be in it too
            for k, t in zip(at.tolist(), text.tolist(), strict=True):
                if k + n <= first[t] + lens[t]:
                    best.update({(t, i): (1.0, 1.0, 1.0) for i in own[int(key[k])]})
    if not items.words:
        return [(t, i, f[2], f[0], f[1]) for (t, i), f in sorted(best.items())]
    at = items.index(h)
    item, one, other = items.hits(at)
    count, sums, before = len(items.words), None, 0
    present = np.zeros(len(items.vocab), bool)
    for length, own in items.scales:
        stride = length // 4
        text, start, end = passages(lens, length, stride)
        low, high = np.maximum(start - stride, first[text]), np.minimum(end + stride, (first + lens)[text])
        mine = np.flatnonzero(np.isin(item, own))
        a, b = np.searchsorted(high, other[mine] + 1), np.searchsorted(low, one[mine], "right")
        n = np.maximum(b - a, 0)
        gate = np.unique((np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())) * count + np.repeat(item[mine], n))
        sums, block = block_sums(items, at, lens, stride, sums if length == 2 * before else None)
        before = length
        block = block[text] + (start - first[text]) // stride
        four = sums[:-3] + sums[1:-2] + sums[2:-1] + sums[3:]
        for c in range(0, len(text), WINDOWS):
            v = four[block[c : c + WINDOWS]]
            cosine = (v @ items.latent[own].T) / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
            x, y = np.nonzero(cosine >= LEAST_COSINE)
            some = gate[np.searchsorted(gate, c * count) : np.searchsorted(gate, (c + WINDOWS) * count)]
            pair = np.union1d((x + c) * count + own[y], some)
            window, k = np.divmod(pair, count)
            near = cosine[window - c, np.searchsorted(own, k)]
            last = -1
            for p, i, cos in zip(window.tolist(), k.tolist(), near.tolist(), strict=True):
                if p != last:
                    seq = at[low[p] : high[p]]
                    seq, last = seq[seq >= 0], p
                inside, least = items.words[i], NEAR_LCS if cos >= LEAST_COSINE else LEAST_LCS
                present[seq] = True
                enough = present[inside].sum() >= least * len(inside) - 1e-9
                present[seq] = False
                if not enough:
                    continue
                share = lcs(items.masks[i], len(inside), seq.tolist()) / len(inside)
                answer = lcs(items.answers[i][0], items.answers[i][1], seq.tolist()) / items.answers[i][1]
                if share >= SURE_LCS or share >= least - 1e-9 and answer >= LEAST_ANSWER:
                    t = int(text[p])
                    found = (share, answer, cos)
                    best[t, i] = max(best.get((t, i), found), found)
    return [(t, i, f[2], f[0], f[1]) for (t, i), f in sorted(best.items())]


def block_sums(items: Items, at: np.ndarray, lens: np.ndarray, stride: int, half: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, first block of each text): latent vectors of blocks of ``stride`` words, with four empty blocks behind each text, so that a
    window is four blocks in a row. ``half``: the sums for half the stride, if known."""
    many = -(-lens // stride) + 4
    begin = np.cumsum(many) - many
    if half is not None:
        halves = -(-lens // (stride // 2)) + 4
        text = np.repeat(np.arange(len(lens)), many)
        place = (np.cumsum(halves) - halves)[text] + np.minimum(2 * (np.arange(len(text)) - begin[text]), halves[text] - 2)
        return half[place] + half[place + 1], begin
    out = np.zeros((int(many.sum()), items.basis.shape[1]), np.float32)
    known = np.flatnonzero(at >= 0)
    text = np.searchsorted(np.cumsum(lens), known, "right")
    block = begin[text] + (known - (np.cumsum(lens) - lens)[text]) // stride
    filled, cut = np.unique(block, return_index=True)
    for c in range(0, len(filled), ROWS):
        upto = cut[c + ROWS] if c + ROWS < len(filled) else len(known)
        out[filled[c : c + ROWS]] = run_sums(items.basis, at[known[cut[c] : upto]], cut[c : c + ROWS] - cut[c])
    return out, begin


def fitted(df: DataFrame, bench: DataFrame, scratch: Scratch) -> Iterator[Items]:
    """Blocks of items, each with its weights and latent space. df: (id, text); bench: (item, text)."""
    bench = bench.where("text IS NOT NULL").distinct()
    n, chars = bench.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(-(-n // BLOCK), -(-(chars or 0) // BLOCK_CHARS))
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        items = Items(sorted(((r["item"], r["text"]) for r in rows), key=str))
        if items.words:
            passages_ = scratch.keep(passage_words(df.select("text"), items), f"passages-{b}")
            items.weigh(*word_counts(passages_, items))
            items.place(latent_basis(passages_, items))
            scratch.drop(f"passages-{b}")
        if items.ids:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, cosine, lcs, answer), one row for each text and item that it holds."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    kinds = {c: x.schema[c].dataType.simpleString() for x, c in ((df, "id"), (bench, "item"))}
    schema = f"`{id_col}` {kinds['id']}, `{item_col}` {kinds['item']}, cosine double, lcs double, answer double"
    out = None
    for k, items in enumerate(fitted(df, bench, scratch)):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch, texts in steps(batches, limit=STEP):
                found = matches(items, texts)
                take = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([items.ids[f[1]] for f in found], bench_type), *[pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)]], names=[id_col, item_col, "cosine", "lcs", "answer"])

        bench_type = pa.array(items.ids).type
        part = df.mapInArrow(search, schema)
        if k >= BLOCKS_AT_ONCE:  # so that the plan does not hold ever more blocks
            part = scratch.keep(part, f"found-{k}")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def cleaned(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, with all columns. Every row is judged by its own text, so ids may be null or repeated."""
    df = docs.select(F.col(text_col).cast("string").alias("text"))
    blocks = fitted(df, benchmark.select(F.lit(0).alias("item"), F.col(item_text).cast("string").alias("text")), scratch)
    at = docs.columns.index(text_col)
    for a, some in enumerate(batched(blocks, BLOCKS_AT_ONCE)):
        if a:  # neither the driver nor a task ever has more than a few blocks
            docs = scratch.keep(docs, f"cleaned-{a}")

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for part, texts in steps(batches, text=at, limit=STEP):
                clean = np.ones(len(texts), bool)
                for items in some:
                    clean[[f[0] for f in matches(items, texts)]] = False
                yield part.filter(pa.array(clean))

        docs = map_rows(docs, run)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))
