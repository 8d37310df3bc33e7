import pytest
from pyspark.sql import functions as F

from recollect.functions import arrays, text, times, vectors
from recollect.schemas import MAX_FILE_BYTES
from recollect.sources.readers import accepted_file, event_lines


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def s(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(("given", "want"), [("a\r\nb", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("", ""), (" \t\n ", ""), (" x﻿", "x"), (None, None), ("\u0085x", "\u0085x")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize_text(s(given))) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "2 KB"), (1048575, "1024 KB"), (1048576, "1.0 MB"), (1572864, "1.5 MB")])
def test_bytes(spark, n, want):
    assert one(spark, text.format_bytes(F.lit(n))) == want


@pytest.mark.parametrize(("name", "want"), [("a.b.txt", "txt"), ("noext", "noext"), ("dot.", "bin"), (None, "bin")])
def test_extension(spark, name, want):
    assert one(spark, text.extension(s(name))) == want


def test_ellipsis(spark):
    assert one(spark, text.ellipsis(s("x" * 18))) == "x" * 18
    assert one(spark, text.ellipsis(s("x" * 19))) == "x" * 16 + "…"


@pytest.mark.parametrize(("url", "want"), [("http://h/?utm_source=a%20b+c", "a b c"), ("http://h/", ""), ("not a url", ""), (None, ""), ("http://h/?utm_source=%zz", "")])
def test_utm(spark, url, want):
    assert one(spark, text.utm(s(url), "utm_source")) == want


def test_marks(spark):
    long = one(spark, text.query_mark(s("q" * 200)))
    assert len(long) == 64 and "\r" not in long
    key = one(spark, text.token_key(s("t")))
    assert len(key) == 32 and not set("+/=") & set(key)


def test_small(spark):
    assert one(spark, text.says_yes(s(" sí, claro"))) is True and one(spark, text.says_yes(s("no"))) is False and one(spark, text.says_yes(s(None))) is False
    assert one(spark, text.last_index(s("a\nb\nc"), "\n")) == 3 and one(spark, text.last_index(s("abc"), "\n")) == -1 and one(spark, text.last_index(s("a\n\nb\n\nc"), "\n\n")) == 4
    assert one(spark, text.email_column_range(s("it's!A:M"))) == "'it''s'!B:B"
    assert one(spark, text.first_of_list(s(" a , b"))) == "a" and one(spark, text.first_of_list(s(None))) == ""
    assert one(spark, text.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, text.signed(F.lit(3))) == "+3" and one(spark, text.signed(F.lit(-3))) == "-3"


@pytest.mark.parametrize(("score", "want"), [(0.75, "auto"), (0.45, "candidate"), (0.4499, "none"), (None, "none"), (float("nan"), "none")])
def test_band(spark, score, want):
    assert one(spark, vectors.band(F.lit(score).cast("double"), 0.75, 0.45)) == want


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(0, 0))) == 0
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0, 0))) is None
    assert one(spark, vectors.cosine(v(1, 1), v(2, 2))) == pytest.approx(1)
    assert one(spark, vectors.normalize(v(0, 0))) == [0, 0]


def test_clamp(spark):
    a = lambda x: F.lit(None).cast("array<string>") if x is None else F.array(*[F.lit(i) for i in x]).cast("array<string>")
    cases = [(None, ["a", "b"], ["a", "b"]), ([], ["a"], []), (["b", "x", "b"], ["a", "b"], ["b", "b"]), (["x"], ["a"], []), (["a"], None, [])]
    for requested, granted, want in cases:
        assert one(spark, arrays.clamp(a(requested), a(granted))) == want


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(spark, arrays.put(m, F.lit("a"), F.lit(7))) == {"a": 7, "b": 2}
    assert one(spark, arrays.put_all(m, F.create_map(F.lit("b"), F.lit(5), F.lit("c"), F.lit(6)))) == {"a": 1, "b": 5, "c": 6}
    assert one(spark, arrays.drop_key(m, F.lit("a"))) == {"b": 2}


@pytest.mark.parametrize(("at", "want"), [(None, "nunca"), ("2024-01-30 23:59:30", "ahora"), ("2024-01-30 23:00:00", "hace 59m"), ("2024-01-30 20:00:00", "hace 3h"), ("2024-01-28 00:00:00", "hace 2d")])
def test_time_ago(spark, at, want):
    assert one(spark, times.time_ago(F.lit(at).cast("timestamp_ntz"), times.moment("2024-01-30 23:59:59"))) == want


def test_files(spark, tmp_path):
    ok = lambda mime, size: one(spark, accepted_file(s(mime), F.lit(size)))
    assert ok("text/plain", 1) and ok("application/pdf", MAX_FILE_BYTES) and not ok("text/plain", MAX_FILE_BYTES + 1) and not ok("image/png", 5) and not ok(None, 5)
    from recollect.sources.readers import read_files

    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.json").write_text('{"k": 1}')
    got = {r["mime_type"]: r["text"] for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"text/csv": "x,y\n1,2\n", "application/json": '{"k": 1}'}


def test_event_lines_round_trip(spark):
    from recollect.schemas import schema
    from recollect.sources.readers import as_event_lines

    e = spark.createDataFrame([("token", "hi\n", None, ["a"]), ("done", None, None, [])], schema("stream_event"))
    assert sorted(map(repr, event_lines(as_event_lines(e)).collect())) == sorted(map(repr, e.collect()))


def test_event_lines(spark):
    lines = spark.createDataFrame([('data: {"type": "token", "delta": "hi"}',), ("",), (": ping",)], "value string")
    assert [(r["type"], r["delta"]) for r in event_lines(lines).collect()] == [("token", "hi")]


def test_thresholds():
    from recollect.operators.classify import HI, LO, thresholds

    assert thresholds({}) == (HI, LO) and thresholds({"CLASSIFY_THRESHOLD_AUTO": "0.9", "CLASSIFY_THRESHOLD_CANDIDATE": "x"}) == (0.9, LO)


def test_parsed_errors(spark):
    """A broken file and an unknown type are errors of their rows only; bytes that are no UTF-8 are replaced."""
    from recollect.schemas import MIME_PDF
    from recollect.sources.readers import parsed

    rows = [(1, bytearray(b"a\xff"), "text/plain"), (2, bytearray(b"no pdf"), MIME_PDF), (3, bytearray(b"x"), "image/png"), (4, None, "text/plain"), (5, bytearray(b"x"), None)]
    df = spark.createDataFrame(rows, "id int, content binary, mime string")
    got = {r["id"]: r["p"] for r in df.select("id", parsed(F.col("content"), F.col("mime")).alias("p")).collect()}
    assert got[1]["text"] == "a\ufffd" and got[1]["error"] is None and got[4]["text"] is None
    assert got[2]["text"] is None and got[2]["error"] and got[3]["error"] == "unsupported type: image/png" and got[5]["error"] == "unsupported type: null"


def test_secrets(spark):
    rows = spark.range(500).select(text.secret_token(F.col("id"), "x-").alias("token"), text.one_time_code(F.col("id")).alias("code")).collect()
    assert len({r["token"] for r in rows}) == 500 and all(r["token"].startswith("x-") and len(r["token"]) == 45 for r in rows)
    assert all(100000 <= int(r["code"]) <= 999999 for r in rows)


def test_json_defaults(spark):
    raw = ['{"n":1}', "{broken", "", None, '{"m":2}', '{"n":"x"}']
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(text.parsed_json(F.col("r"), "n long", F.struct(F.lit(-1).cast("long").alias("n")))["n"], text.parsed_json(F.col("r"), "n long").isNull()).collect()
    assert list(map(tuple, got)) == [(1, False), (-1, True), (-1, True), (-1, True), (None, False), (-1, True)]
