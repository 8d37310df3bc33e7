"""Runs of words, multiset fingerprints and Merkle manifests against plain versions of them, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from recollect.llm import merkle_manifest as mm
from recollect.llm import multiset_hash as mh
from recollect.llm import word_runs as wr
from recollect.llm.common import Scratch

SF = "/root/testdata/sf0.001"
GAP = "[\x20\x09-\x0d]+"


def all_runs(w, least=24, periods=3):
    """(start, length, period), by trying every period and looking for a smaller one."""
    n, out = len(w), set()
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(least, periods * p) and not any(all(w[t] == w[t + q] for t in range(i, i + size - q)) for q in range(1, p)):
                out.add((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        seqs = []
        for _ in range(rng.randrange(1, 10)):
            n, k = rng.randrange(0, 110), rng.choice([1, 2, 3, 9, 60])
            s = [rng.randrange(1, k + 1) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
            seqs.append(s)
        least, periods = rng.choice([(24, 3), (6, 2), (2, 2), (9, 3), (12, 4)])
        flat = np.array([x for s in seqs for x in (*s, 0)], np.int64)
        found = wr.find_runs(flat, np.repeat(np.arange(len(seqs)), [len(s) + 1 for s in seqs]), least, periods)
        want = [(d, *r) for d, s in enumerate(seqs) for r in all_runs(s, least, periods)]
        assert sorted(map(tuple, found.tolist())) == sorted(want)


def test_op12_by_brute_force(spark):
    got = {r["doc_id"]: tuple(r) for r in wr.op12_word_runs(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for d, text in (x for x in docs if len(x[1] or "") < 4000):
        w = [x for x in re.split(GAP, text or "") if x]
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = all_runs(w)
        gone = {t for s, size, p in runs for t in range(s + p, s + size)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{p}\n" for s, size, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        assert got[d] == (d, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_runs_odd_rows(spark):
    long = " ".join(map(str, range(50_000))) + " a b c" * 20_000
    rows = [(1, None, "x"), (1, "", "x"), (None, " \t\n", None), (2, "ab cd " * 30, "y"), (2, "ab cd " * 30, "y"), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("t", F.lit(7)).withColumn("c0", F.lit("c"))
    got = wr.with_runs(docs).collect()
    assert wr.with_runs(docs).columns == ["doc_id", "text", "t", "c0", "runs", "collapsed"] and len(got) == 6 and {(r["t"], r["c0"]) for r in got} == {(7, "c")}
    told = sorted(([tuple(x) for x in r["runs"]], len(r["collapsed"].split())) for r in got)
    assert told == [([], 0)] * 3 + [([(0, 60, 2)], 2)] * 2 + [([(50_000, 60_000, 3)], 50_003)]
    assert next(r["text"] for r in got if r["doc_id"] == 1 and r["text"] != "") is None
    assert wr.with_runs(docs.limit(0)).count() == 0


def paragraphs(text):
    return Counter(p for p in re.split("\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", text or "") if p)


def test_op11_by_brute_force(spark):
    """Edited texts exactly; likeness within its error; equal texts and none other have equal fingerprints."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    before, mh.LEAST = mh.LEAST, 10_000  # many stretches
    try:
        got = {r["doc_id"]: r for r in mh.op11_multiset_hash(spark, SF).collect()}
    finally:
        mh.LEAST = before
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1 DESC").fetchall()
    dot = lambda a, b: sum(n * b[p] for p, n in a.items())
    for k, (d, text) in enumerate(docs):
        after, cut, r = docs[(k + 1) % len(docs)][1], len(text) // 3, got[d]
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = paragraphs(text), paragraphs(other)
            assert abs(2 * dot(a, b) / (dot(a, a) + dot(b, b)) - near) < 0.4
    groups = {(got[d]["fingerprint"], tuple(sorted(paragraphs(t).items()))) for d, t in docs}
    assert len(groups) == len({f for f, _ in groups}) == len({p for _, p in groups})


def collected(spark, texts):
    """Fingerprints of texts by their number."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.explode_outer(mh.paragraphs(F.col("text"))).alias("p"))
    hashed = df.select("i", *[h.alias(f"h{k}") for k, h in enumerate(mh.paragraph_hashes(F.col("p")))])
    return hashed.groupBy("i").agg(mh.summed([F.col(f"h{k}") for k in range(mh.LANES // 64)]).alias("f"))


def test_fingerprints_add_up(spark):
    f = collected(spark, ["one\ntwo\nthree", "three\none\ntwo", "one\ntwo", "three", "one\ntwo\nthree\nthree", None])
    wide = f.groupBy().pivot("i", list(range(6))).agg(F.first("f"))
    c = {k: F.col(str(k)) for k in range(6)}
    row = wide.select(
        (c[0] == c[1]).alias("order"), (mh.plus(c[2], c[3]) == c[0]).alias("insert"), (mh.minus(c[0], c[3]) == c[2]).alias("delete"), (c[0] != c[4]).alias("twice"),
        (mh.plus(mh.minus(c[5], c[3]), c[3]) == c[5]).alias("below_zero"), mh.likeness(c[0], c[1]).alias("same"), mh.likeness(c[5], c[5]).alias("none"), mh.likeness(c[5], c[0]).alias("empty"),
    ).first()
    assert all(row[k] for k in ("order", "insert", "delete", "twice", "below_zero")) and (row["same"], row["none"], row["empty"]) == (1.0, 1.0, 0.0)


def edits(spark, rows, least=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, b int")
    before, mh.LEAST = mh.LEAST, least
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4b")
    try:
        return mh.with_fingerprints(docs, Scratch(spark, "test"), lambda t, after: F.concat_ws("|", t, after)).collect()
    finally:
        mh.LEAST = before
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_fingerprints_odd_rows(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert edits(spark, []) == []
    assert edits(spark, [(5, "a", "x", 1)])[0]["edited_sha256"] == sha("a|a")
    rows = [(1, "one", "x", 1), (None, None, None, None), (2, None, "x", 1), (2, "", "x", 1), (3, "y" * 300_000, "x", 1), (4, "four", "x", 1), (4, "four", "x", 1), (None, "last", "x", 1)]
    got = edits(spark, rows)
    assert len(got) == 8 and Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(r[1] or "",) for r in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = Counter((d, sha(f"{t}|{order[(k + 1) % 8][1]}")) for k, (d, t) in enumerate(order))
    assert Counter((r["id"], r["edited_sha256"]) for r in got) == want


def root_of(level):
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 8]).encode()).hexdigest() for k in range(0, len(level), 8)]
    return level[0]


def test_manifest_trees(spark):
    """Groups of many sizes around the powers of the fan-out, in one bucket and in several; ties, nulls and equal rows."""
    sizes = {None: 5000, "": 1, "a": 8, "b": 9, "é": 64, "z": 65, "~": 4097}
    rows = [(g, None if k < 3 else k // 2, hashlib.sha256(f"{g}{k // 5}".encode()).hexdigest()) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, h string").withColumn("x", F.col("h")).repartition(7)
    out = mm.manifest(df, Scratch(spark, "test")).withColumn("folded", mm.fold(F.col("h"), F.col("proof"), F.col("places"))).collect()
    assert len(out) == len(rows) and all(r["folded"] == r["root"] for r in out)
    subs = []
    for g in sorted(sizes, key=lambda g: (g is not None, (g or "").encode())):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        subs.append(root_of([r[2] for r in mine]))
        told = sorted((r for r in out if r["g"] == g), key=lambda r: r["i"])
        assert [(r["i"], r["h"], r["subroot"]) for r in told] == [(i, r[2], subs[-1]) for i, r in enumerate(mine)]
    assert {r["root"] for r in out} == {root_of(subs)}
    assert mm.manifest(df.limit(0), Scratch(spark, "test")).count() == 0


def test_digest(spark):
    df = spark.createDataFrame([(1, None, "é"), (None, "", "-")], "a int, b string, c string").select(mm.digest(F.col("a"), F.col("b"), F.col("c")).alias("d"))
    assert [r["d"] for r in df.collect()] == [hashlib.sha256(x.encode()).hexdigest() for x in ("1:1-2:é", "-0:1:-")]
