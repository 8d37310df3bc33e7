"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes of the lower-cased text, digits and symbols counting as gaps), weighted by
sub-linear term frequency and inverse document frequency and scaled to length one. The document frequencies
come from all training documents, summed on the executors. For each language a bounded sample of its
training documents is clustered by spherical k-means into several centroids. A text takes the language of the centroid
with the greatest cosine; if that cosine lies below what the centroid's own documents reach, the
prediction is marked as rejected, while ``lang_pred`` still tells the nearest language.

Every language is learned, from at least one text. The sample, at most ``SAMPLE_PER_LANGUAGE`` texts a language and about ``SAMPLE`` in all, is picked by a hash of
the text, so ids may be null or repeated; equal texts count once there. Languages are clustered on the executors, one group each; only centroids,
no more of them than the sample has texts, come to the driver.

Null texts and texts without a letter are ``und`` with score 0. Without any training document every text is
``und``. Ties go to the centroid first in order (language, then cluster). Repeated rows are judged alike; an empty
table gives an empty result; other columns are not read. Texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, steps, table

#: Hashed n-gram dimensions.
DIMS = 4096
#: Training texts that are clustered: so many a language and so many in all, at most, but one of every language.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 6000
CENTROIDS, ROUNDS = 4, 12
#: ASCII letters and all bytes of other characters stay; every other byte is a gap between words.
LETTERS = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))
#: A prediction is rejected below this part of the cosine that 99 in 100 of a centroid's documents reach.
REJECT_SHARE, REJECT_QUANTILE = 0.8, 0.01


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed 2- and 3-byte sequences, one row per text."""
    raw = [t.lower().encode("utf-8", "surrogatepass").translate(LETTERS) for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), lens) * DIMS
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(doc))  # bytes from here to the text's end
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
    out = np.zeros(len(raw) * DIMS, np.int64)
    for code, size in ((two[: len(doc)], 2), (three[: len(doc)], 3)):
        code = code ^ (code >> np.uint32(15))
        key = doc + ((code * np.uint32(0x2C1B3C6D)) >> np.uint32(20))
        gap = (b[: len(doc)] == 0x20) & (b[1 : len(doc) + 1] == 0x20)
        out += np.bincount(key[(left >= size) & ~gap], minlength=len(out))
    return out.reshape(len(raw), DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    v = np.log1p(ngram_counts(texts)).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Of every dimension over all rows of a one-column DataFrame of texts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for _, part in steps(batches, text=0, rows=256):
            df += (ngram_counts(part) > 0).sum(0)
            n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(df, n))], names=["bin", "n"])

    rows = texts.mapInArrow(sums, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(DIMS + 1)
    for r in rows:
        total[r["bin"]] = r["n"]
    return np.log((1 + total[-1]) / (1 + total[:-1])).astype(np.float32) + np.float32(0.1)


def cluster(v: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: unit centroids and each row's cosine to its own."""
    rng = np.random.default_rng(seed)
    c = v[[rng.integers(len(v))]]
    while len(c) < min(k, len(v)):
        c = np.vstack([c, v[[int(np.argmin((v @ c.T).max(1)))]]])
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c, v @ c.T


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.floors, self.idf = langs, centroids, floors, idf

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(texts, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        top = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        blank = np.array([not any(map(str.isalpha, t)) for t in texts], bool)
        langs = ["und" if e else self.langs[b] for b, e in zip(best, blank, strict=True)]
        return langs, np.where(blank, 0.0, top), blank | (top < self.floors[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` with a language and a non-empty text; ids are not looked at."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where((F.length("text") > 0) & F.col("lang").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    idf = inverse_frequencies(rows.select("text"))
    languages = rows.agg(F.countDistinct("lang")).first()[0]
    per = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // max(1, languages)))
    # every task keeps its first ``per`` hashes a language before they are shuffled, so that no language is ranked whole
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = rows.select("lang", "h").distinct().withColumn("r", first).where(F.col("r") <= per).drop("r")
    sample = rows.join(F.broadcast(picked) if languages <= SAMPLE else picked, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, rows=256):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in vectors(texts, idf)], pa.binary())], names=["lang", "v"])

    def centres(part: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(sorted(part["v"].to_pylist())), np.float32).reshape(-1, DIMS)
        c, cos = cluster(v, CENTROIDS)
        own = [cos[cos.argmax(1) == j, j] for j in range(len(c))]
        floors = [REJECT_SHARE * float(np.quantile(x, REJECT_QUANTILE)) if len(x) else 0.0 for x in own]
        return pa.table({"lang": pa.array([part["lang"][0].as_py()] * len(c), pa.string()), "c": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary()), "floor": pa.array(floors, pa.float64()), "j": pa.array(range(len(c)), pa.int32())})

    found = sample.mapInArrow(embed, "lang string, v binary").groupBy("lang").applyInArrow(centres, "lang string, c binary, floor double, j int").collect()
    found.sort(key=lambda r: (r["lang"], r["j"]))
    centroids = np.frombuffer(b"".join(bytes(r["c"]) for r in found), np.float32).reshape(-1, DIMS)
    return Model([r["lang"] for r in found], centroids, np.array([r["floor"] for r in found]), idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected), one row per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.centroids, model.floors, model.idf))  # at most CENTROIDS a language, and no more than the sample has texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch, texts in steps(batches, rows=256):
            langs, cos, rejected = own.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(cos), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
