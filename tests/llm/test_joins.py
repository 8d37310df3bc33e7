"""N-gram join, decontamination and language model against brute force and on odd inputs."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from recollect.llm import decontamination, katz_lm, ngram_join
from recollect.llm.common import Scratch, crc_mod

DOC = "doc_id long, text string, lang string, source string, n_chars long, n string, component_id string, score double"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


# ---- n-gram join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, d in enumerate(ids):
        low[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None) if sets[i] else d) for i, d in enumerate(ids)), key=repr)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=40)
    out = []
    for _ in range(n):
        words = rng.choices(vocab, k=rng.choice([3, 5, 8, 30, 60]))
        if rng.random() < 0.3:
            words = words[:10] + passage + words[10:]
        out.append(words)
    texts = [" ".join(w) for w in out]
    for _ in range(n):  # chains of edits near the threshold
        w = rng.choice(out)
        w = list(w)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(w)
        texts.append(rng.choice([" ", "\n", "\t "]).join(w).upper())
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_join_brute(spark, monkeypatch, small):
    if small:  # every split and salt in use
        for k, v in (("GROUP_CLASSES", 3), ("QUERIES", 2), ("HOT", 3), ("GROUP_TOKENS", 100)):
            monkeypatch.setattr(ngram_join, k, v)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d", "A B C D ", *corpus(random.Random(8 + small), 100)]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids += [ids[-1], None]
    texts += [texts[-1], texts[-2]]
    got = sorted(map(tuple, ngram_join.components(docs(spark, texts, ids), Scratch(spark, "t")).collect()), key=repr)
    assert got == brute_components(ids, texts)


def test_join_family(spark):
    """Hundreds of copies that differ in one word each, and exact copies."""
    base = [f"q{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 120)] * 2 + [" ".join(base)] * 50
    got = ngram_join.components(docs(spark, texts), Scratch(spark, "t")).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 290


def test_join_empty_and_dedup(spark):
    assert ngram_join.components(docs(spark, []), Scratch(spark, "t")).count() == 0
    assert ngram_join.components(docs(spark, [None, ""]), Scratch(spark, "t")).count() == 2
    long = " ".join(f"w{i}" for i in range(30_000))
    kept = ngram_join.deduplicated(docs(spark, ["a b c d e f", "a b c d e f", None, "", "z", long, long + " tail", "z"], [3, 1, 5, 6, 7, 8, 9, 7]), Scratch(spark, "t"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6, 7, 8] and kept.columns == docs(spark, []).columns


def test_dedup_odd_rows(spark):
    """Null ids, clashing and dotted column names, repeated rows, rows without words."""
    text = "one two three four five six"
    rows = [(None, text, 1), (None, text, 1), (7, "z", 1), (7, "z", 2), (9, "z", 3), (None, "only here without a name at all", 4), (None, "only here without a name at all", 5), (4, None, 6), (4, None, 6), (None, " ", 7), (3, text.upper(), 8)]
    df = spark.createDataFrame([(i, t, n, "x", "y", "w", "v") for i, t, n in rows], "`doc.id` long, text string, n int, key string, _text_hash string, `a.b` string, row string")
    kept = ngram_join.deduplicated(df, Scratch(spark, "t"), "doc.id")
    got = sorted(((r["doc.id"], r["text"]) for r in kept.collect()), key=repr)
    assert kept.columns == df.columns
    assert got == sorted([(3, text.upper()), (7, "z"), (None, "only here without a name at all"), (4, None), (4, None), (None, " ")], key=repr)


def test_join_below_threshold(spark):
    """A family of texts that share most shingles and yet do not link, beside some that do."""
    rng = random.Random(4)
    base = [f"q{i}" for i in range(80)]
    texts = []
    for k in range(150):
        w = list(base)
        for x in rng.sample(range(80), 3):
            w[x] = f"new{k}x{x}"
        texts.append(" ".join(w))
    texts += [t + " tail" for t in texts[:20]]
    assert sorted(map(tuple, ngram_join.components(docs(spark, texts), Scratch(spark, "t")).collect()), key=repr) == brute_components(list(range(len(texts))), texts)


# ---- decontamination


def bench_items(rng, n=30):
    return [" ".join(f"{rng.choice('abcdef')}{rng.randrange(300)}" for _ in range(rng.randrange(12, 60))) for _ in range(n)]


def filler(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(2000)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(6)
    items = bench_items(rng) + [None, "", "none of these"]
    texts, want = [None, "", "word"], set()
    for d in range(3, 120):
        w = filler(rng, rng.choice([5, 80, 400]))
        if d % 3 == 0:
            k = rng.randrange(30)
            leak = items[k].split()
            if d % 2:  # a paraphrase: a tenth of the words replaced, others dropped, case and marks changed
                leak = [x if rng.random() > 0.1 else "zz" for x in leak if rng.random() > 0.05]
                leak = [x.upper() + "," if rng.random() < 0.3 else x for x in leak]
            at = rng.randrange(len(w))
            w[at:at] = leak
            want.add((d, k))
        texts.append(" ".join(w))
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(items)], "item_id long, text string, cosine double")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs(spark, texts), bench, Scratch(spark, "t")).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want)
    exact = {(d, k) for d, k in want if d % 2 == 0}
    assert exact <= got
    kept = decontamination.cleaned(docs(spark, texts), bench, Scratch(spark, "t"))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(len(texts))) - {d for d, _ in got}


def paraphrases(rng, n=200):
    """(items, texts, kinds): for each of n items a text with a copy of which few words are replaced (near), or one in which half of all words are, the
    common ones first (far); the last words stay."""
    common = [f"the{k}" for k in range(30)]
    items = [" ".join(rng.choice(common) if k % 2 and k < size - 6 else f"{rng.choice('abcdef')}{rng.randrange(3000)}" for k in range(size)) for size in (rng.randrange(20, 60) for _ in range(n))]
    texts, kinds = [], []
    for i, item in enumerate(items):
        w = item.split()
        if i % 2:
            gone = [k for k in range(len(w) - 6) if w[k].startswith("the")]
            gone += rng.sample([k for k in range(len(w) - 6) if k not in gone], max(0, round(0.46 * len(w)) - len(gone)))
        else:
            gone = rng.sample(range(len(w) - 6), len(w) // 10)
        kinds.append("far" if i % 2 else "near")
        w = [f"y{rng.randrange(90)}" if k in gone else x for k, x in enumerate(w)]
        around = [" ".join(rng.choice(common) if rng.random() < 0.4 else x for x in filler(rng, 60)) for _ in range(2)]
        texts.append(f"{around[0]} {' '.join(w)} {around[1]}")
    return items, texts, kinds


def test_each_source_finds_its_paraphrases(spark, monkeypatch):
    """Far paraphrases come by the cosine alone: without it, or with an empty latent space, they are lost; near ones need none. No text gets another's item."""
    items_, texts, kinds = paraphrases(random.Random(9))
    items = decontamination.Items(list(enumerate(items_)))
    df = docs(spark, texts).selectExpr("doc_id AS id", "text")
    items.weigh(*decontamination.frequencies(df.select("text"), items))
    basis = decontamination.latent_basis(decontamination.sampled(df.select("text"), len(texts), items), items)

    def found():
        got = {(t, items.ids[i]) for t, i, *_ in decontamination.matches(items, texts)}
        assert all(t == i for t, i in got)
        return {k: sum(kinds[t] == k for t, _ in got) / kinds.count(k) for k in ("near", "far")}

    items.place(basis)
    whole = found()
    monkeypatch.setattr(decontamination, "LEAST_COSINE", 2.0)
    without = found()
    monkeypatch.undo()
    items.place(np.zeros(basis.shape))
    assert found() == without == {"near": 1, "far": 0}
    assert whole["near"] == 1 and whole["far"] >= 0.9


def test_block_sums(spark):
    """Sums of four blocks are the sums over the words of a window."""
    rng = np.random.default_rng(4)
    items = decontamination.Items([(0, "a b c d e f g h i j k l m n o p")])
    items.basis = rng.normal(size=(16, 5)).astype(np.float32)
    lens = np.array([3, 0, 64, 40, 1])
    at = rng.integers(-1, 16, lens.sum())
    first, half = np.cumsum(lens) - lens, None
    for stride in (8, 16, 32):
        sums, begin = decontamination.block_sums(items, at, lens, stride, half)
        assert np.allclose(sums, decontamination.block_sums(items, at, lens, stride)[0], atol=1e-4)
        for t, s, e in zip(*decontamination.passages(lens, 4 * stride, stride), strict=True):
            b = begin[t] + (s - first[t]) // stride
            assert np.allclose(sums[b : b + 4].sum(0), sum((items.basis[w] for w in at[s:e] if w >= 0), np.zeros(5)), atol=1e-4)
        half = sums


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(decontamination.bit_masks(np.array(a, int)), len(a), b) == t[-1][-1]


def test_no_benchmark(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs(spark, ["a b c"]), empty, Scratch(spark, "t")).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontamination.contaminated(docs(spark, []), some, Scratch(spark, "t")).count() == 0
    assert decontamination.contaminated(docs(spark, ["x"]), some.selectExpr("item_id", "CAST(NULL AS STRING) AS text"), Scratch(spark, "t")).count() == 0


# ---- language model


def brute_katz(texts, held, order):
    toks = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + [b"\n"] for t in texts]
    grams = lambda t, k: [tuple(([b"\0"] * (k - 1) + t)[i : i + k]) for i in range(len(t))]
    c = {k: collections.Counter(g for t, h in zip(toks, held, strict=True) if not h for g in grams(t, k)) for k in range(1, order + 1)}
    n, v = sum(c[1].values()), len(c[1])
    d = {k: katz_lm.discounts(np.array([sum(1 for x in c[k].values() if x == r) for r in range(1, katz_lm.GT + 2)])) for k in c}
    disc = lambda x, k: x * (d[k][x] if x <= katz_lm.GT else 1)
    seen = sum(disc(x, 1) for x in c[1].values())
    below = n + (n - seen <= 0)
    unknown = 1 - seen / below if n else 1.0
    den, alpha = {}, {}

    def p(g):
        if len(g) == 1:
            return disc(c[1][g], 1) / below if c[1][g] else unknown
        return disc(c[len(g)][g], len(g)) / den[g[:-1]] if c[len(g)][g] else alpha.get(g[:-1], 1) * p(g[1:])

    for k in range(2, order + 1):
        after = collections.defaultdict(list)
        for g in c[k]:
            after[g[:-1]].append(g)
        for h, gs in after.items():
            count, mass = sum(c[k][g] for g in gs), sum(disc(c[k][g], k) for g in gs)
            den[h] = count + (mass >= count * (1 - 1e-12))
            alpha[h] = (1 - mass / den[h]) / (1 - sum(p(g[1:]) for g in gs))
        for h in after:  # exactly normalised over all words and the unknown one
            assert sum(p((*h, *w)) for w in c[1]) + p((*h, b"never seen")) == pytest.approx(1, abs=1e-9)
    rows = []
    for t, h in zip(toks, held, strict=True):
        base = sum(math.log10((c[1][w,] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        rows.append((h, len(t), sum(c[1][w,] > 0 for w in t), n, base, sum(math.log10(p(g)) for g in grams(t, order))))
    return rows


@pytest.mark.parametrize("segment, order", [(1_000_000, 2), (50, 2), (50, 3), (1_000_000, 4)])
def test_katz_brute(spark, monkeypatch, segment, order):
    monkeypatch.setattr(katz_lm, "SEGMENT", segment)
    monkeypatch.setattr(katz_lm, "BUCKET", 40)
    rng = random.Random(7)
    texts = [None, "", "the the the the the the the the", "É é"] + [" ".join(rng.choices([f"w{i}" for i in range(40)], weights=[1 / (i + 1) for i in range(40)], k=rng.randrange(30))) for _ in range(80)]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    want = brute_katz(texts, held, order)
    out, model = katz_lm.fit_and_score(docs(spark, texts).repartition(3), crc_mod("doc_id", 5) == 1, Scratch(spark, "t"), order=order)
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i][:4] == w[:4] and got[i][4] == pytest.approx(w[4], abs=1e-8) and got[i][5] == pytest.approx(w[5], abs=1e-8)
    assert {r["kind"] for r in model["ngrams"].select("kind").collect()} == set(range(1, order + 1))
    assert {r["kind"] for r in model["backoff"].select("kind").collect()} == set(range(2, order + 1))


def test_katz_query(spark, tmp_path):
    """The registered query is the model at its default order, split by ids."""
    docs(spark, ["a b c", None, "b c a b"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in katz_lm.op4_katz_lm(spark, str(tmp_path)).collect()}
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(3)]
    for i, w in enumerate(brute_katz(["a b c", None, "b c a b"], held, katz_lm.ORDER)):
        assert tuple(got[i])[1:5] == w[:4] and got[i]["score"] == pytest.approx(w[5], abs=1e-8)


def test_katz_odd(spark):
    from pyspark.sql import functions as F

    assert katz_lm.fit_and_score(docs(spark, []), F.lit(False), Scratch(spark, "t"))[0].count() == 0
    with pytest.raises(ValueError):
        katz_lm.fit_and_score(docs(spark, ["a"]), F.lit(False), Scratch(spark, "t"), order=1)
    rows = katz_lm.fit_and_score(docs(spark, ["a b", None]), F.lit(True), Scratch(spark, "t"))[0].collect()  # nothing to learn from
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in rows] == [(3, 0, 0.0), (1, 0, 0.0)]
    out, model = katz_lm.fit_and_score(docs(spark, ["a b a b", "a " * 5000]), F.lit(False), Scratch(spark, "t"))
    assert out.count() == 2 and model["ngrams"].where("kind = 2").count() >= 1 and model["backoff"].count() >= 1


def test_discounts_fall_back():
    assert (katz_lm.discounts(np.zeros(6)) > 0).all() and (katz_lm.discounts(np.array([5, 0, 3, 0, 0, 1]))[1:] < 1).all()
    d = katz_lm.discounts(np.array([1000, 400, 200, 110, 70, 45]))
    assert (d[1:] > 0).all() and (d[1:] < 1).all() and d[0] == 1


def test_katz_segment_is_lean():
    rng = np.random.default_rng(3)
    tokens = rng.zipf(1.3, 300_000) % 50_000
    vocab, back = np.unique(tokens, return_inverse=True)
    n = np.full(300, 1000, np.int32)
    row = {"lens": katz_lm.pack(n), "train": katz_lm.pack(np.ones(300, np.uint8)), "vocab": katz_lm.pack_sorted(vocab.astype(np.uint64) * np.uint64(1 << 40)), "tokens": katz_lm.pack(back.astype(np.uint32))}
    katz_lm.Segment(row, 2)
    tracemalloc.start()
    s = katz_lm.Segment(row, 2)
    kept, most = (x / len(tokens) for x in tracemalloc.get_traced_memory())
    tracemalloc.stop()
    assert kept < 22 and most < 55  # bytes a token; with 64-bit places and np.unique 28 and 72
    pairs = set(zip(np.where(np.arange(len(back)) % 1000, np.roll(back, 1), -1).tolist(), back.tolist(), strict=True))
    assert len(s.keys[2]) == len(pairs) and s.times[2].sum() == len(tokens)
