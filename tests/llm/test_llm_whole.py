"""Whole results of the training-data operators, against brute force."""

import random

import numpy as np

from recollect.llm import decontamination, sentencepiece_codec

DOC = "id long, text string"


def skewed(rng, n):
    """Words of a skewed distribution, so that items hold common and rare ones."""
    return [f"w{int(rng.paretovariate(0.5))}" if rng.random() < 0.9 else f"r{rng.randrange(5000)}" for _ in range(n)]


def every_pair(items, texts):
    """What the last check finds in every window of every text, with neither gate nor cosine."""
    out, d = set(), decontamination
    for t, text in enumerate(texts):
        at = items.index(d.words([text])[0])
        for length, own in items.scales:
            _, start, end = d.passages(np.array([len(at)]), length, length // 4)
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                seq = [x for x in at[max(0, s - length // 4) : e + length // 4].tolist() if x >= 0]
                for i in own.tolist():
                    share = d.lcs(items.masks[i], len(items.words[i]), seq) / len(items.words[i])
                    answer = d.lcs(items.answers[i][0], items.answers[i][1], seq) / items.answers[i][1]
                    if share >= d.SURE_LCS or share >= d.LEAST_LCS and answer >= d.LEAST_ANSWER:
                        out.add((t, i))
    return out


def test_rare_words_replaced(spark):
    """Paraphrases of 200 items whose rarest words are replaced are found like the last check alone finds them."""
    rng = random.Random(12)
    bench = [skewed(rng, rng.randrange(12, 60)) for _ in range(200)]
    items = decontamination.Items([(i, " ".join(w)) for i, w in enumerate(bench)])
    plain = [" ".join(skewed(rng, rng.randrange(50, 400))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(plain)), DOC)
    items.weigh(*decontamination.frequencies(df.select("text"), items))
    items.place(decontamination.latent_basis(decontamination.sampled(df.select("text"), 600, items), items))
    texts = []
    for i, w in enumerate(bench):
        w, heavy = list(w), np.argsort(-items.idf[items.words[i]])
        for x in heavy[: int(len(w) * rng.choice([0.1, 0.2, 0.3]))].tolist():
            w[x] = "zz"
        texts.append(" ".join(skewed(rng, 30) + w + skewed(rng, 30)))
    want, got = every_pair(items, texts), {(t, i) for t, i, *_ in decontamination.matches(items, texts)}
    assert got == want and sum(t == i for t, i in want) >= 190


def test_every_text_compared(spark):
    """Parity is told of every text that is not null, and each distinct piece goes through the decoder."""
    texts = [*sentencepiece_codec.HARD, *(f"text number {i}, été {i * i}" for i in range(100)), None]
    rows = sentencepiece_codec.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sentencepiece_codec.model_bytes()).collect()
    assert all((r["parity"], r["roundtrip"]) == ((None, None) if texts[r["doc_id"]] is None else (True, True)) for r in rows) and len(rows) == len(texts)
    codec, seen = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes()), []
    real = codec.decode
    codec.decode = lambda ids: seen.extend(ids) or real(ids)
    codec.encode(["one two one"])
    assert len(seen) == 2


def test_sample_is_bounded(spark, monkeypatch):
    """Null, repeated and missing ids and repeated texts do not swell the sample."""
    monkeypatch.setattr(decontamination, "SAMPLE_DOCS", 100)
    items = decontamination.Items([(0, "a b c d e f g h")])
    items.weigh(np.ones(8), 10)
    df = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS id", "IF(id % 3 = 0, 'a b c d', concat('a b ', id, ' ', repeat('x ', 2000))) AS text")
    assert 40 <= decontamination.sampled(df.select("text"), 20_000, items).count() <= 16 * 160


def test_short_items_exact(spark, tmp_path):
    """Items of one to four words count where their words stand in a row in one text, over null and repeated ids."""
    bench = [(1, "Zebra!"), (2, "blue moon"), (3, "one two three"), (4, "w x y z"), (5, "..."), (None, "one two three"), (2, "blue moon"), (6, "long item with more than five words in it"), (7, "日本の首都は東京")]
    texts = ["a zebra.", "BLUE, moon", "blue sky moon", "blue", "moon one two", "three", "one  two\nthree", "w x y", "z", "", None, "so long item with more than five words in it is", "w x y z " * 30_000, "x日本の首都は東京です。", "日本"]
    from recollect.llm.common import Scratch

    for name in ("one block", "many"):
        if name == "many":
            real, decontamination.BLOCK = decontamination.BLOCK, 1
        try:
            b = spark.createDataFrame(bench, "item_id long, text string")
            df = spark.createDataFrame([(None if i == 1 else i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, item string, cosine string")
            got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, b, Scratch(spark, "t")).collect()}
            assert got == {(0, 1), (None, 2), (6, 3), (6, None), (11, 6), (12, 4), (13, 7)}, name
            kept = decontamination.cleaned(df, b, Scratch(spark, "t"))
            assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 7, 8, 9, 10, 14]
        finally:
            if name == "many":
                decontamination.BLOCK = real


def test_space_of_all_passages(spark, monkeypatch):
    """The latent space is the one of every passage of every text, repeated ones too, and of the items: compared with the whole matrix."""
    from recollect.llm.common import Scratch

    d, rng = decontamination, random.Random(3)
    monkeypatch.setattr(d, "RANK", 8)
    monkeypatch.setattr(d, "EXTRA", 100)
    monkeypatch.setattr(d, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(d, "COMMON", 10)
    monkeypatch.setattr(d, "ROWS", 7)
    monkeypatch.setattr(d, "WEIGHED_AT", 20_000)
    bench = [" ".join(f"w{rng.randrange(40)}" for _ in range(12)) for _ in range(20)]
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.4)), 60)}" for _ in range(rng.randrange(0, 3000 if i % 50 == 0 else 90))) for i in range(400)] + ["w1 w2 w3"] * 50 + [None, "", "nothing known"]
    items = next(d.fitted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5), spark.createDataFrame(list(enumerate(bench)), "item long, text string"), Scratch(spark, "t")))
    rows = []
    for t in texts:
        at = items.index(d.words([t or ""])[0])
        rows += [np.bincount(at[k : k + d.PASSAGE][at[k : k + d.PASSAGE] >= 0], minlength=len(items.vocab)) for k in range(0, len(at), d.PASSAGE)]
    a = np.array(rows, float)
    assert len(a) > 16 * d.SAMPLE_DOCS and np.allclose(items.idf, np.log((1 + len(a)) / (1 + (a > 0).sum(0))) + 0.1)
    own = np.array([np.bincount(w, minlength=len(items.vocab)) for w in items.words], float)
    a, own = d.unit(a * items.idf), d.ITEM_WEIGHT * d.unit(own * items.idf)
    want = np.linalg.svd(np.concatenate([a, own]), full_matrices=False)[2][:8].T
    got = items.basis / items.idf[:, None]
    assert got.shape == want.shape and np.abs(got @ got.T - want @ want.T).max() < 1e-3


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """A word that only the labelled rows beyond the first 2,000 of a class hold is learned; rows are gone over some at a time."""
    from pyspark.sql import functions as F

    from recollect.llm import toxicity

    monkeypatch.setattr(toxicity, "SEGMENT_WORDS", 8000)
    rng, n = random.Random(4), 2700
    order = [r["id"] for r in spark.range(0, 2 * n, 2).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[2000:])
    texts = {i: " ".join([f"n{rng.randrange(300)}" for _ in range(7)] + ([] if i % 2 else ["grue" if i in late else "vile"])) for i in range(2 * n)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in texts], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    for own in (late, set(order[:2000]), {i for i in texts if i % 2}):
        assert np.mean([(r["score"] >= toxicity.CUT) == (r["doc_id"] % 2 == 0) for r in got if r["doc_id"] in own]) > 0.95


def test_round_is_the_mean_of_its_tasks(spark):
    """Tasks' changes are averaged by their rows, a bucket's over the tasks that changed it."""
    from recollect.llm import toxicity

    texts = [f"a{i % 7} b{i % 5} common only{i // 20}" for i in range(50)]
    rows = [(i, i % 2, bytearray(c)) for i, c in enumerate(toxicity.coded(texts))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "id long, label int, x binary")
    parts = [[tuple(r) for r in p] for p in df.rdd.glom().collect() if p]
    assert len(parts) == 3
    trainer = toxicity.Trainer((25, 25))
    before, changes = trainer.state(), []
    for p in parts:
        own = toxicity.Trainer((25, 25))
        p.sort(key=lambda r: str(r[0]))
        own.learn(toxicity.uncoded([bytes(r[2]) for r in p])[0], np.array([r[1] for r in p]), np.random.default_rng([5, 0]), 2)
        changes.append([x.astype(float) - y for x, y in zip(own.state(), before, strict=True)])
    toxicity.one_round(df, trainer, 0, 2)
    n = np.array([len(p) for p in parts], float)
    touched = np.array([(c[0] != 0).any(1) for c in changes])
    want = sum(k * c[0] for k, c in zip(n, changes, strict=True)) / np.maximum((n[:, None] * touched).sum(0), 1)[:, None]
    after = trainer.state()
    assert np.allclose(after[0] - before[0], want, atol=1e-5) and np.allclose(after[1] - before[1], sum(k * c[1] for k, c in zip(n, changes, strict=True)) / n.sum(), atol=1e-5)


def test_pipeline_fits_on_all_texts(spark, tmp_path, monkeypatch):
    """The pipeline's stages take no sample: neither of texts for the latent space nor of labels."""
    import corpus_pipeline
    from recollect.llm import common, toxicity

    def fails(*a, **b):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(decontamination, "sampled", fails)
    monkeypatch.setattr(common, "labelled_sample", fails)
    monkeypatch.setattr(toxicity, "labelled_sample", fails, raising=False)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(40)) for _ in range(60)]
    leak = "the capital of this country is a fine place to be in all year"
    df = spark.createDataFrame([*enumerate(texts), (60, f"so {leak} he said")], "doc_id long, text string")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, df, str(tmp_path)).columns == df.columns
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()} == set(range(60))
