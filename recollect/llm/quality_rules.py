"""Quality rules: counting rules plus the divergence of a document's histograms from language references.

Each text gives, in one pass, the counts of the base rules, a histogram of byte classes and a histogram of
common words. Summed over all documents by the ``lang`` column the histograms are the references; a
document is compared with every language's reference by Jensen-Shannon distance (base 2, 0 to 1), and the
nearest language counts, so that a wrong label rejects nobody. Texts below the guards are not compared. Every
language with a word is a reference, however rare: some 150 numbers each come to the driver, and texts are compared with them in blocks. A
language all of whose texts are odd is its own reference and keeps them.

Null and empty texts have no words and fail the base rules. Texts count whole, however long: words and windows as they are
written, common words in either case. Rows are judged one by one: repeated rows and
ties are judged alike. Documents with a null ``lang`` are compared, but are no reference. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, segment_sums, steps, table, word_hashes

#: Function words of widely written European languages; their shares tell running text from lists and noise.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se il sont avec ce son ou cette mais aux sa fait comme nous leur",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo",
}
WORDS = sorted({w for text in COMMON.values() for w in text.split()})
#: Byte classes: lower, upper, digit, white space, sentence punctuation, shouting, symbols, other ASCII, Latin letters beyond ASCII, other scripts, rest.
CLASSES = 11
#: A text with fewer words is not compared by common words; one with fewer letters not by classes.
MIN_WORDS, MIN_CHARS = 50, 200
#: Rejected beyond these distances.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45
#: Pairs of a text and a reference that are compared at once.
PAIRS = 16_000


def byte_classes() -> np.ndarray:
    c = np.full(256, 7)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 0, 1, 2
    c[[9, 10, 11, 12, 13, 32]] = 3
    c[[ord(x) for x in ".,;:'\"-()?"]] = 4
    c[ord("!")] = 5
    c[[ord(x) for x in "#*$%&|<>"]] = 6
    c[0x80:0xC0] = -1  # continuation bytes belong to the byte before
    c[0xC0:0xC4], c[0xC4:0xCA], c[0xCA:0xF0], c[0xF0:] = 8, 8, 9, 10
    return c


def common_hashes() -> np.ndarray:
    return np.sort(word_hashes(WORDS)[0])


def features(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and histograms of some texts. common: the sorted hashes of WORDS."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    by_byte = np.bincount(owner * 256 + np.frombuffer(b"".join(raw), np.uint8), minlength=256 * n).reshape(n, 256)
    classes = byte_classes()
    onehot = (classes[:, None] == np.arange(CLASSES)).astype(np.int64)
    h, lens = word_hashes(texts, fold=False)
    folded = word_hashes(texts)[0]
    at = np.searchsorted(common, folded).clip(max=len(common) - 1)
    hit = common[at] == folded
    doc = np.repeat(np.arange(n), lens)
    by_word = np.bincount(doc * (len(common) + 1) + np.where(hit, at, len(common)), minlength=n * (len(common) + 1)).reshape(n, -1)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            key = mix(h[:-2] * np.uint64(3) + mix(h[1:-1] + np.uint64(1)) * np.uint64(5) + mix(h[2:] + np.uint64(2)) + mix(doc[:-2].astype(np.uint64)))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, back, times = np.unique(key[inside], return_inverse=True, return_counts=True)
        starts = inside[times[back] >= 2]
        for k in range(3):
            covered[starts + k] = True
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if "\n" in t:
            seen = set()
            for line in t.split("\n"):
                if line in seen:
                    dup[i] += 1
                elif line.strip(" \t\n\x0b\x0c\r"):
                    seen.add(line)
    points = by_byte[:, classes >= 0].sum(1)
    return {
        "n_words": lens,
        "word_chars": points - by_byte[:, [9, 10, 11, 12, 13, 32]].sum(1),
        "n_symbols": by_byte[:, [ord(x) for x in "#*$%&|<>"]].sum(1),
        "n_dup_lines": dup,
        "n_repeat_words": segment_sums(covered.astype(np.int64), lens),
        "classes": by_byte @ onehot,
        "words": by_word,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, counts, classes binary, words binary), the histograms as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = common_hashes()
        for batch, texts in steps(batches):
            f = features(texts, common)
            hist = [pa.array([r.tobytes() for r in f[k].astype(np.int32)], pa.binary()) for k in ("classes", "words")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(f[c].astype(np.int64)) for c in COUNTS], *hist], names=[id_col, "lang", *COUNTS, "classes", "words"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, classes binary, words binary"
    return df.select(id_col, F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, schema)


def references(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class and word histograms, one row per language; summed on the executors, a language code is one row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            both = np.concatenate([np.frombuffer(b"".join(b.column(k).to_pylist()), np.int32).reshape(b.num_rows, -1) for k in (1, 2)], 1)
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + both[langs == lang].sum(0, dtype=np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "hist"])

    parts = measured.where(F.col("lang").isNotNull()).select("lang", "classes", "words").mapInArrow(sums, "lang string, hist array<long>")
    bins = parts.select("lang", F.posexplode("hist").alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    whole = bins.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("h"))
    rows = whole.where(F.exists(F.slice("h", CLASSES + 1, len(WORDS) + 1), lambda n: n > 0)).orderBy("lang").collect()
    hist = np.array([r["h"] for r in rows], np.float64).reshape(len(rows), CLASSES + len(WORDS) + 1)
    return hist[:, :CLASSES], hist[:, CLASSES:]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histogram rows p to reference rows q, base 2; nan for an empty histogram."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (p / p.sum(1, keepdims=True))[:, None, :]
        q = (q / q.sum(1, keepdims=True))[None, :, :]
        m = (p + q) / 2
        kl = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / m), 0).sum(2)
        out = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where(np.isnan(p[:, :, 0]), np.nan, out)


def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least distance of each row of p to a row of q, in blocks of either; nan where p is empty or q has no row."""
    out, many = np.full(len(p), np.nan), max(1, min(len(q), PAIRS // 8))
    for k in range(0, len(q), many):
        rows = max(1, PAIRS // many)
        for i in range(0, len(p), rows):
            out[i : i + rows] = np.fmin(out[i : i + rows], js_distance(p[i : i + rows], q[k : k + many]).min(1))
    return out


def assess(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, counts, class_distance, word_distance, kept_by_divergence); distances are null below the guards."""
    measured = scratch.keep(measure(df, id_col, text_col, lang_col), "measured")
    ref_classes, ref_words = references(measured)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wide = {k: np.frombuffer(b"".join(b.column(k).to_pylist()), np.int32).reshape(b.num_rows, -1).astype(np.float64) for k in ("classes", "words")}
            n_words = b.column("n_words").to_numpy()
            far = []
            for k, ref, most in (("classes", ref_classes, wide["classes"].sum(1) >= MIN_CHARS), ("words", ref_words, n_words >= MIN_WORDS)):
                far.append(np.where(most, nearest(wide[k], ref), np.nan))
            bad = (far[0] > MAX_CLASS_DISTANCE) | (far[1] > MAX_WORD_DISTANCE)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (id_col, *COUNTS)], *[pa.array(x, mask=np.isnan(x)) for x in far], pa.array(~bad)], names=[id_col, *COUNTS, "class_distance", "word_distance", "kept_by_divergence"])

    return measured.mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, class_distance double, word_distance double, kept_by_divergence boolean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assess(table(spark, sf_dir, "documents"), Scratch(spark, "quality-rules"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.col("kept_by_divergence")).alias("kept"), "class_distance", "word_distance")
