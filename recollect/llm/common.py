"""Helpers shared by the training-data operators: reading, scratch tables, batches, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy step handles at once; a longer text is a step of its own.
STEP_CHARS = 2_000_000
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: One task writes so many folders of a partitioned table side by side, without sorting its rows first.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``: rows hold whole texts, and both sides of a Python worker
    hold a batch outside the heap. Limits that are lower already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, modulus: int):
    """crc32 of an id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def per_worker(key, make):
    """What ``make()`` gives, kept by this Python worker for its later tasks; one thing at a time."""
    cache = sys.modules.setdefault("_recollect_worker", types.ModuleType("_recollect_worker")).__dict__
    if cache.get("key") != key:
        cache["key"], cache["value"] = None, None
        cache["value"], cache["key"] = make(), key
    return cache["value"]


def forget() -> None:
    """What ``per_worker`` keeps for other operators goes."""
    per_worker("nothing", dict)


def give_back() -> None:
    """Freed memory of this worker goes back to the system, so that an idle worker is a small one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give back by themselves
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables of one run in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session, whose executors are
    threads of the driver, may leave it unset; then a folder of the machine is used. Results of operators read
    tables there, so they stay until ``close``; ``Scratch.close_all`` closes what a name's operators have opened.
    While a table is written a setting of the session is changed, so queries that write at the same time need sessions of their own.
    """

    opened: list["Scratch"] = []
    #: Those opened while ``collecting`` in this context.
    _mine: ContextVar[list["Scratch"] | None] = ContextVar("scratches", default=None)

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = os.path.join(tempfile.gettempdir(), "recollect-scratch")
        small_batches(spark)
        self.spark = spark
        self.root, self.name = f"{base}/{name}-{uuid.uuid4().hex}", name
        Scratch.opened.append(self)
        if (mine := Scratch._mine.get()) is not None:
            mine.append(self)

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table, in folders by the columns ``by``, and read it back; that cuts the lineage at a place that survives executors."""
        path = f"{self.root}/{name}"
        mine = {CLEAN: "true"} | ({WRITERS: "16"} if by else {})  # what was shuffled for the table is of no use once it is written
        before = {k: self.spark.conf.get(k, None) for k in mine}
        try:
            for k, v in mine.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Delete all tables, once the results that read them have been written or collected."""
        self.drop()
        if self in Scratch.opened:
            Scratch.opened.remove(self)

    @classmethod
    @contextlib.contextmanager
    def collecting(cls) -> Iterator[list["Scratch"]]:
        """A list of what operators open inside, and in no other thread or task, to be closed by the caller."""
        token = cls._mine.set([])
        try:
            yield cls._mine.get()
        finally:
            cls._mine.reset(token)

    @classmethod
    def close_all(cls, prefix: str) -> None:
        for s in [s for s in cls.opened if s.name.startswith(prefix)]:
            s.close()


def steps(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = STEP_CHARS, rows: int = 10_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches so that each has at most ``limit`` bytes of text and ``rows`` rows, or one row. Null texts become
    empty. Only one step's texts are Python strings at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > limit or i - start >= rows:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(text).to_pylist()]
                start, size = i, 0
            size += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
    part = batch = None
    give_back()


def map_rows(df: DataFrame, run) -> DataFrame:
    """``mapInArrow`` from whole rows to rows of the same columns, whatever these are called; batches have their columns in order."""
    small_batches(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters (what bytes.split() cuts at)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(texts: list[str], replace: bytes | None = None, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts (cut at ASCII white space, with ``fold`` A-Z lower-cased), and each text's number of words.

    Eight bytes of every word are mixed in at a time, for all words at once. ``replace`` maps each byte to another before that.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if replace:
        raw = [r.translate(replace) for r in raw]
    data = b" ".join(raw)
    if fold:
        data = data.lower()
    buffer = np.frombuffer(b" " + data + b" " * 9, np.uint8)
    gap = GAP[buffer[: len(data) + 2]]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # starts and ends in turn
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    limits = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) + 1
    lens = np.diff(np.searchsorted(starts, limits), prepend=0)
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[starts] & LOW_BYTES[np.minimum(sizes, 8)]))
        for k in range(8, LONG_WORD, 8):
            more = np.flatnonzero(sizes > k)
            if not len(more):
                break
            h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[starts[more] + k] & LOW_BYTES[np.minimum(sizes[more] - k, 8)]))
    long = np.flatnonzero(sizes > LONG_WORD)
    if len(long):
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(data[s - 1 : s - 1 + n]) for s, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
    return h, lens


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segment_sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, zero for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, reduce, kind: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(rows (id, label, x) of at most ``per_class`` documents a class, labelled documents a class).

    ``x``, of Spark type ``kind``, is what ``reduce(texts)`` gives for each of a list of texts; it is computed where the text lies, so that
    no text is shuffled or collected. Which documents is decided by a hash of their id. Only ids of the sample are broadcast, at most
    ``2 * per_class``. An id with several labels counts with the highest, one with several texts with the
    smallest ``x``; null ids, labels and labels other than 0 and 1 are left out.
    """
    y = F.col(label).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(y).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").select("id", "text", "label")
    schema = rows.select("id", "label").withColumn("x", F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(reduce(texts), pa.binary() if kind == "binary" else pa.list_(pa.float64()))], names=["id", "label", "x"])

    return rows.mapInArrow(run, schema).groupBy("id", "label").agg(F.min("x").alias("x")), counts
