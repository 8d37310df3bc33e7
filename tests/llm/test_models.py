"""Trained operators by held-out accuracy, the codec by round trip and parity, the pipeline by brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import language_id, quality_model, quality_rules, sentencepiece_codec, toxicity
from recollect.llm.common import words_of

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, predicted string"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, "x", "y") for i, t, lang in rows], DOC)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD = [(None, "null id", "en"), (900_001, None, "en"), (900_002, "", None), (900_003, "12345 !!! 678", "en"), (900_004, "word " * 60_000, None), (900_005, "x" * 150_000, "de"), (900_006, "twice", "en"), (900_006, "twice", "en")]


def tables(spark, path, doc_rows, label_rows):
    docs(spark, doc_rows).write.parquet(f"{path}/documents.parquet")
    labels(spark, label_rows).write.parquet(f"{path}/labels.parquet")
    return str(path)


def held(i, mod, at):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == at


def accuracy(spark, query, name, mod=3):
    truth = {r["doc_id"]: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in query(spark, SF).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == held(r["doc_id"], mod, 1) and 0 <= r["score"] <= 1 for r in rows)
    mine = [r for r in rows if r["held_out"]]
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in mine]), mine, truth


# ---- toxicity


def test_toxicity_held_out(spark):
    acc, rows, truth = accuracy(spark, toxicity.op3_toxicity, "toxic")
    assert acc >= 0.9 and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def toxic_rows(n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(200)}" for _ in range(rng.randrange(20, 80))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "grimest", "grimly"]))
        out.append((i, " ".join(w), "en"))
    return out, [(i, 1, int(i % 4 == 0)) for i in range(n)]


def test_toxicity_odd(spark, tmp_path):
    rows, lab = toxic_rows()
    path = tables(spark, tmp_path, rows + ODD, [*lab, (5, 1, 0), (5, 1, None), (None, 1, 1), (777_777, 1, 1)])
    got = toxicity.op3_toxicity(spark, path).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    mine = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in mine]) > 0.85
    twice = [r["score"] for r in got if r["doc_id"] == 900_006]
    assert twice[0] == twice[1]
    # scores come from texts only
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows).withColumn("lang", F.lit("zz")), toxicity.fit(docs(spark, rows), labels(spark, lab).where("toxic IS NOT NULL"))).collect()}
    plain = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows).withColumn("source", F.lit("q")), labels(spark, lab))).collect()}
    assert again == plain


def test_toxicity_without_labels(spark, tmp_path):
    path = tables(spark, tmp_path, ODD, [])
    assert {r["score"] for r in toxicity.op3_toxicity(spark, path).collect()} == {0.0}
    empty = tables(spark, tmp_path / "none", [], [])
    assert toxicity.op3_toxicity(spark, empty).count() == 0
    assert toxicity.accepted(docs(spark, ODD), toxicity.Net()).count() == len(ODD)


def test_pool_by_hand():
    net = toxicity.Net(3)
    texts = [words_of(t) for t in ("a b c d", "", "a", "c c c b a d e f g")]
    rows = toxicity.Table(net)
    z, _ = toxicity.raw_scores(net, texts, rows)
    for t, got in zip(texts, z, strict=True):
        e = np.array([net.embed[toxicity.buckets(w)].sum(0) for w in t] + [np.zeros(toxicity.DIMS)] * 3, np.float32)
        pooled = []
        for width in toxicity.WIDTHS:
            k = [net.filters[:, (c := toxicity.PLACES.index((width, j)) * toxicity.FILTERS) : c + toxicity.FILTERS] for j in range(width)]
            pooled.append(np.max([sum(e[i + j] @ k[j] for j in range(width)) for i in range(len(t) + 1)], 0))
        assert got == pytest.approx(float(net.logits(np.concatenate(pooled)[None])[0]), abs=1e-4)


def test_coded_texts_score_alike():
    """What the training reads gives the log odds and languages that scoring reads off the words."""
    net = toxicity.Net(4)
    texts = ["the cat and the (dog)", "", "der Hund, und die Katze.", "é! 'x' the", "a " * 3000, "\n"]
    z, lang = toxicity.raw_scores(net, [words_of(t) for t in texts], toxicity.Table(net))
    codes = toxicity.coded(texts)
    head = 4 * len(toxicity.LANGS)
    assert toxicity.raw_coded(net, [np.frombuffer(c[head:], np.uint16).reshape(-1, 4) for c in codes]) == pytest.approx(z, abs=1e-4)
    for c, x in zip(codes, lang, strict=True):
        marks = np.frombuffer(c[:head], np.float32)
        assert (marks.argmax() if marks.max() > 0 else -1) == x


def test_best_cut_brute():
    """The cut is the one of greatest weighted F1 of all cuts between different scores."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        z, y, w = rng.integers(0, 8, 20) / 2, rng.integers(0, 2, 20), rng.random(20)
        if y.sum() in (0, 20):
            continue
        f1 = lambda c: 2 * (w * y)[z >= c].sum() / (w[z >= c].sum() + (w * y).sum())
        assert f1(toxicity.best_cut(z, y, w)) == pytest.approx(max(f1(c) for c in np.unique(z)))


def test_calibration_by_language():
    """Each language with enough labelled rows gets its own threshold; its score there is the cut."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        words = ["the", "and", "that"] if i % 2 else ["der", "und", "nicht"]
        bad = i % 3 == 0
        text = " ".join(words + [f"w{rng.randrange(100)}" for _ in range(20)] + (["vile"] if bad else []))
        rows.append((i, int(bad), toxicity.coded([text])[0]))
    net = toxicity.calibrated(rows, {0: 600, 1: 300})
    aside = [r for r in rows if zlib.crc32(f"calibrate {r[0]}".encode()) % 5 == 0]
    head = 4 * len(toxicity.LANGS)
    for x, name in enumerate(toxicity.LANGS):
        own = [r for r in aside if np.frombuffer(r[2][:head], np.float32).argmax() == x]
        want = toxicity.best_cut(toxicity.raw_coded(net, [np.frombuffer(r[2][head:], np.uint16).reshape(-1, 4) for r in own]), np.array([r[1] for r in own]), np.ones(len(own))) if own else net.shift[-1]
        assert net.shift[x] == pytest.approx(want, abs=1e-3), name
    text = "the and that w1 w2"
    z, lang = toxicity.raw_scores(net, [words_of(text)], toxicity.Table(net))
    assert toxicity.scores(net, [text], toxicity.Table(net))[0][0] == pytest.approx(1 / (1 + np.exp(-(z[0] - net.shift[lang[0]] + np.log(toxicity.CUT / (1 - toxicity.CUT))))))


def test_statistics_by_hand():
    text = "The cat sat.\nThe cat sat.\n#1 $2 ÉÉ"
    common = quality_model.common_hashes()
    got = quality_model.statistics([text, ""], common)
    words = text.split()
    hits = [sum(w.encode().lower().decode() == c for w in words) for c in quality_rules.WORDS]
    want = [np.log1p(len(words)), sum(map(len, words)) / len(words), 2 / len(words), 1 / 3, 6 / len(words), len(words) / 3, sum(hits) / len(words), sum(h > 0 for h in hits) / np.sqrt(len(words)), max(hits) / len(words)]
    assert got[0, :9] == pytest.approx(want) and got[1, :9] == pytest.approx([0, 0, 0, 0, 0, 1, 0, 0, 0])
    assert got[0, 9:].sum() == pytest.approx(1)


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 5)
    net = toxicity.Net(3)
    small, big = toxicity.Table(net), toxicity.Table(net)
    for part in (["a", "b", "c", "d", "e", "f"], ["g", "a"], ["h"] * 4):
        words = [[w.encode() for w in part]]
        assert toxicity.raw_scores(net, words, small)[0] == pytest.approx(toxicity.raw_scores(net, words, big)[0])


# ---- quality


def test_quality_held_out(spark):
    acc, rows, truth = accuracy(spark, quality_model.op7_quality_model, "quality")
    assert acc >= 0.95 and all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_odd(spark, tmp_path):
    path = tables(spark, tmp_path, ODD, [])
    assert {r["score"] for r in quality_model.op7_quality_model(spark, path).collect()} == {0.5}
    assert quality_model.op7_quality_model(spark, tables(spark, tmp_path / "none", [], [])).count() == 0


def test_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(int)
    f = quality_model.grow(x, y, np.ones(600))
    assert ((f.score(x) > 0.5) == y).mean() > 0.97
    for row in x[:20]:  # the flat arrays against a walk from node to node
        out = f.prior
        for feature, threshold, value in zip(f.feature, f.threshold, f.value, strict=True):
            node = 0
            while node < 2**quality_model.DEPTH - 1:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            out += value[node - (2**quality_model.DEPTH - 1)]
        assert f.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-out)))


# ---- language


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language_id.op5_language_id(spark, SF).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.95


def test_language_odd(spark, tmp_path):
    rows = [(i, f"the house of the dog and the cat number{i}", "en") for i in range(20)] + [(100 + i, f"der hund und die katze mit dem haus nummer{i}", "de") for i in range(20)]
    got = {r["doc_id"]: r for r in language_id.op5_language_id(spark, tables(spark, tmp_path, rows + ODD, [])).collect()}
    assert got[900_001]["lang_pred"] == got[900_002]["lang_pred"] == got[900_003]["lang_pred"] == "und" and got[900_001]["score"] == 0
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.op5_language_id(spark, tables(spark, tmp_path / "unlabelled", [(1, "some text", None)], []))
    assert none.first()["lang_pred"] == "und"
    assert language_id.op5_language_id(spark, tables(spark, tmp_path / "none", [], [])).count() == 0


def test_language_many(spark):
    """Two thousand languages of a text or two are all learned, beside large ones, one whose ids are all null and one whose rows share an id."""
    rare = spark.range(2_000).selectExpr("id AS doc_id", "concat('w', id, ' text ', id * 7) AS text", "concat('x', id) AS lang")
    own = lambda word, lang, key: spark.range(300).selectExpr(f"{key} AS doc_id", f"concat('{word} ', id)", f"'{lang}'")
    parts = [own("the house of the dog number", "en", "id + 20000"), own("der hund und die katze nummer", "de", "CAST(NULL AS BIGINT)"), own("el perro y la casa numero", "es", "1234L"), own("le chien et la maison numero", "fr", "999L")]
    df = rare
    for x in parts:
        df = df.unionAll(x)
    model = language_id.fit(df)
    assert len(set(model.langs)) == 2_004 and len(model.centroids) <= language_id.SAMPLE
    assert model.predict(["the house of the dog", "der hund und die katze", "el perro y la casa", "le chien et la maison"])[0] == ["en", "de", "es", "fr"]


def test_language_nearest_brute(spark):
    """Predictions of every text are those of the greatest cosine, computed text by text from n-gram dictionaries."""
    import math

    rows = [(i, f"the house of the dog and cat {i}", "en") for i in range(30)] + [(100 + i, f"der hund und die katze {i}", "de") for i in range(30)] + [(200, "", None), (201, "X", None), (202, "el perro y el gato", None)]
    df = docs(spark, rows)
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    train = [language_id.ngram_counts([t])[0] for _, t, x in rows if x and t]
    idf = [math.log((1 + len(train)) / (1 + sum(bool(t[j]) for t in train))) + 0.1 for j in range(language_id.DIMS)]
    assert model.idf == pytest.approx(np.array(idf), abs=1e-5)
    for i, t, _ in rows:
        v = {j: math.log1p(n) * idf[j] for j, n in enumerate(language_id.ngram_counts([t])[0].tolist()) if n}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cos = [sum(x / norm * float(c[j]) for j, x in v.items()) for c in model.centroids]
        if any(map(str.isalpha, t)):
            assert got[i]["score"] == pytest.approx(max(0, max(cos)), abs=1e-4) and cos[model.langs.index(got[i]["lang_pred"])] <= max(cos)
            assert max(c for c, x in zip(cos, model.langs, strict=True) if x == got[i]["lang_pred"]) == pytest.approx(max(cos), abs=1e-4)
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_ngrams_do_not_cross_texts():
    both = language_id.ngram_counts(["abc", "", "de"])
    assert (both[0] == language_id.ngram_counts(["abc"])[0]).all() and both[1].sum() == 0 and both[0].sum() == 3 and both[2].sum() == 1


# ---- codec


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())


def test_codec_parity(spark, codec):
    rng = random.Random(3)
    chars = list("aä .,;\n\t\r1!?-'\"▁») ") + ["the", "é", "日", "😀", "²", "<s>", "  ", "\x00", "word."]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(500)] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect()]
    assert codec.verify(texts) == []


def test_codec_parser(codec):
    m = codec.model
    assert len(m.pieces) == codec.slow.get_piece_size() and all(p == codec.slow.id_to_piece(i) and s == pytest.approx(codec.slow.get_score(i)) for i, (p, s, _) in enumerate(m.pieces[::97]) for i in [i * 97])


def unigram_model(tmp_path):
    """A tiny unigram model file, written field by field."""
    def field(number, kind, data):
        tag = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        return tag + (bytes([len(data)]) if kind == 2 else b"") + data

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -5.0, 1), ("bc", -5.5, 1), ("▁abc", -9.0, 1)]
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    trainer = field(3, 0, bytes([1])) + field(35, 0, bytes([1]))
    return out + field(2, 2, trainer) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01"))


def test_codec_unigram(tmp_path):
    c = sentencepiece_codec.Codec(unigram_model(tmp_path))
    assert c.model.kind == sentencepiece_codec.UNIGRAM
    assert c.verify(["abc", " abc  bca ", "cab", "", "aé", "abcabc ab"]) == []


def test_codec_round_trip(spark, tmp_path):
    rows = [(1, "Hello  world.\nNext (one), l'été».", None), (2, "日本 🧿", None), *ODD]
    out = sentencepiece_codec.op2_sentencepiece(spark, tables(spark, tmp_path, rows, [])).cache()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[900_001]["ids"] is None and got[900_001]["roundtrip"] is None and got[900_002]["ids"] == [] and got[900_002]["n_tokens"] == 0
    assert all(r["roundtrip"] for r in got.values() if r["ids"] is not None) and all(r["parity"] in (None, True) for r in got.values()) and got[2]["n_bytes"] > 0
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decoded(out, sentencepiece_codec.model_bytes()).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert sentencepiece_codec.op2_sentencepiece(spark, tables(spark, tmp_path / "none", [], [])).count() == 0


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from recollect.llm import ngram_join, secret_scan

    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in d.collect()}
    bench = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at, kept = d, [set(before)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        rows = at.collect()
        kept.append({r["doc_id"] for r in rows})
        assert len(rows) == len(kept[-1]) and kept[-1] <= kept[-2]
        if name != "sentencepiece":
            assert at.columns == d.columns
        if name == "ngram_join":
            ids = sorted(kept[-2])
            sets = {i: set(s.tolist()) for i, s in zip(ids, ngram_join.shingle_sets([before[i]["text"] for i in ids]), strict=True)}
            parent = {i: i for i in ids}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for k, i in enumerate(ids):
                for j in ids[:k]:
                    a, b = sets[i], sets[j]
                    if a and 0.8 * len(b) <= len(a) <= 1.25 * len(b) and 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
                        x, y = sorted((find(i), find(j)))
                        parent[y] = x
            assert kept[-1] == {find(i) for i in ids}
        if name == "decontamination":
            holds = {i for i in kept[-2] if any(b in " ".join(before[i]["text"].lower().split()) for b in bench)}
            assert kept[-2] - kept[-1] == holds
        if name == "secret_scan":
            keys = secret_scan.automaton()
            assert kept[-1] == kept[-2]
            for r in rows:
                assert not secret_scan.spans_of(r["text"], keys) and ("[REDACTED]" in r["text"]) == bool(secret_scan.spans_of(before[r["doc_id"]]["text"], keys))
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == kept[-1]


def test_pipeline_odd(spark, tmp_path):
    """Null ids, null, empty and very long texts, repeats, clashing and dotted columns, empty tables."""
    import corpus_pipeline

    rows = [(None, "null id here with some words", "a"), (None, "null id here with some words", "b"), (1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "long word " * 50_000, "a"), (4, "same text as the next one", "a"), (4, "same text as the next one", "b"),
            (5, "Same text as the next one", "a"), (6, "so the capital of this country is a fine place to be in all year", "a"), (None, "the capital of this country is a fine place to be in all year", "a"), (7, "my password = hunter22 is here", "a")]
    df = spark.createDataFrame([(i, t, "en", None, 3, n, 0.5, "k") for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars int, `a.b` string, label double, key string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the capital of this country is a fine place to be in all year")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    at = df
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        assert at.columns == df.columns, name
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in at.collect()), key=repr)
    want = [(None, rows[0][1], len(rows[0][1])), (1, None, 3), (2, "", 0), (2, "", 0), (3, rows[5][1], 500_000), (4, rows[6][1], len(rows[6][1])), (7, "my [REDACTED] is here", 21)]
    assert got == sorted(want, key=repr)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(want) and sum(r["ids"] is None for r in out) == 1
    for name, schema in (("documents", df.schema), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_known_pieces_and_plain_normalising_cost_nothing():
    """Pieces of a large vocabulary stay known; the short way to a normalised text gives what the library's normaliser gives."""
    from recollect.llm import sentencepiece_codec as sc

    codec = sc.Codec(sc.model_bytes())
    codec.kept = {f"{i}": b"" for i in range(300_000)}
    codec.encode(["a text"])
    assert "299999" in codec.kept
    for t in [*sc.HARD, " ", f"{sc.MARK}{sc.MARK} x", "\n "]:
        full = codec.fast.normalizer.normalize_str(t).replace(sc.MARK, " ")
        assert codec.normalised(t) == (full[1:] if codec.model.dummy_prefix and full else full)
