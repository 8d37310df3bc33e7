import datetime as dt
import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions.times import moment
from recollect.operators import access, classify, graph, growth, imports, ingest, leads, limits, membership, search
from recollect.schemas import schema
from recollect.sources.personas import personas

NOW = "2024-01-30 23:59:59"


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_chunks_hard_cuts():
    assert [len(c) for c in ingest.chunks("x" * 10_000)] == [4000, 4000, 2000]
    assert ingest.chunks("") == [] and ingest.chunks("a" * 4000) == ["a" * 4000]
    assert len(ingest.chunks("a" * 4001)) == 2
    assert len(ingest.chunks("x" * 2_000_000)) == 200


def test_chunks_soft_breaks():
    at = lambda n: "a" * n + "\n" + "b" * 6000
    assert len(ingest.chunks(at(2000))[0]) == 4000  # in the middle: not used
    first, second = ingest.chunks(at(2001))[:2]
    assert first == "a" * 2001 and second.startswith("a" * 400 + "\nb")
    assert ingest.chunks("a" * 2500 + "\n\n" + "c" * 500 + "\n" + "b" * 6000)[0] == "a" * 2500


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", min_size=0, max_size=400))
def test_chunks_cover(text):
    text = text.strip(ingest.TRIM)
    at = 0
    for c in ingest.chunks(text, 50, 5):
        found = text.find(c, max(0, at - 60))
        assert found >= 0 and not text[at:found].strip(ingest.TRIM)
        at = max(at, found + len(c))
    assert not text[at:].strip(ingest.TRIM)


def test_ingest_again(spark):
    files = spark.createDataFrame([("f1", "hello"), ("f2", "x" * 9000), ("f3", None)], "file_id string, text string")
    jobs = spark.createDataFrame([("f1", "u", "manual"), ("f2", "u", "manual"), ("f2", "u", "manual"), ("f3", "u", "manual")], "file_id string, user_id string, source string")
    empty = spark.createDataFrame([], "memory_id string, file_id string, user_id string, source string, text string")
    once = ingest.ingest(jobs, files, empty).localCheckpoint()
    again = ingest.ingest(jobs, files, once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) and once.count() == 4


def test_job_status(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "e" * 600, 2), ("c", "boom", 3)], "file_id string, error string, attempts int")
    got = {r["file_id"]: (r["status"], len(r["error"] or "")) for r in ingest.job_status(rows).collect()}
    assert got == {"a": ("indexed", 0), "b": ("pending", 500), "c": ("failed", 4)}


def test_areas(spark):
    m = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,), (["gone"],)], "space_ids array<string>")
    spaces = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    assert [tuple(r) for r in growth.areas(m, spaces).collect()] == [("a", "A", 2, 50), ("b", "B", 1, 25), ("c", "C", 0, 0)]
    none = growth.areas(m.where("false"), spaces)
    assert {r["percentage"] for r in none.collect()} == {0}


def test_series_bounds(spark):
    rows = [(1, 1, "a", 1, ts("2024-01-23 23:59:59")), (2, 1, "a", 2, ts("2024-01-23 23:59:58")), (3, 1, None, 3, ts("2024-01-30 10:00:00")), (4, 2, "zz", 4, ts("2024-01-30 10:00:00"))]
    e = spark.createDataFrame(rows, "id long, user_id long, space_id string, memory_id long, created_at timestamp_ntz")
    spaces = spark.createDataFrame([("a", "A")], "id string, name string")
    got = {(r["space_id"], r["space_name"], r["count"]) for r in growth.growth_series(e, spaces, moment(NOW)).collect()}
    assert got == {("a", "A", 1), ("", growth.UNLABELLED, 1), ("zz", "zz", 1)}
    assert growth.growth_series(e, spaces, moment(NOW), user_id=2).count() == 1
    assert tuple(growth.growth_totals(e, moment(NOW)).first()) == (2, 3, 1, 2)
    assert tuple(growth.growth_totals(e.where("false"), moment(NOW)).first()) == (0, 0, 0, 0)


def test_activity_order(spark):
    c = spark.createDataFrame([(1, "x", False, None), (2, "y", False, ts("2024-01-02")), (3, "z", True, None), (4, "w", False, ts("2024-01-03"))], "id long, label string, revoked boolean, last_seen timestamp_ntz")
    log = spark.createDataFrame([(1, 2, "search", ts("2024-01-02"))], "id long, connection_id long, action string, created_at timestamp_ntz")
    assert [(r["id"], r["total_calls"]) for r in access.access_activity(c, log).collect()] == [(1, 0), (4, 0), (2, 1)]


def test_default_deny(spark):
    items = spark.createDataFrame([(1, 1, ["a"], [1.0, 0.0]), (2, 1, [], [1.0, 0.0]), (3, 2, ["a"], [1.0, 0.0])], "id long, user_id long, space_ids array<string>, vector array<double>")
    req = spark.createDataFrame([(1, 1, ["a"], ["b"], [1.0, 0.0]), (2, 1, None, ["a"], [1.0, 0.0]), (3, 1, [], ["a"], [1.0, 0.0]), (4, 1, None, [], [1.0, 0.0])], "request_id long, user_id long, requested array<string>, granted array<string>, vector array<double>")
    got = [(r["request_id"], r["id"]) for r in search.top_k(search.effective_labels(req), items).collect()]
    assert got == [(2, 1)]
    assert search.filter_items(items, 1, []).count() == 2  # no labels: no condition at this level
    with pytest.raises(ValueError):
        search.top_k(req, items, 0)


def most_rows(plan) -> int:
    """The most rows that a node of an executed plan has put out."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_same_questions_are_ranked_once(spark):
    items = spark.range(300).selectExpr("id", "1L AS user_id", "array(IF(id % 2 = 0, 'a', 'b')) AS space_ids", "array(1.0D, id / 100D) AS vector")
    req = spark.range(200).selectExpr("id AS request_id", "1L AS user_id", "array(0.0D, 1.0D) AS vector", "IF(id % 2 = 0, array('a', 'b'), array('b', 'a', 'b')) AS effective")
    hits = search.top_k(req, items, 2)
    got = {(r["request_id"], r["id"], r["rank"]) for r in hits.collect()}
    assert got == {(q, i, n) for q in range(200) for i, n in ((299, 1), (298, 2))}
    assert most_rows(hits._jdf.queryExecution().executedPlan()) <= 600  # not 200 * 300


def test_top_k_without_own_item(spark):
    items = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 1, [1.0, 0.2])], "id long, user_id long, vector array<double>")
    req = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (9, 1, [1.0, 0.0]), (9, 1, [1.0, 0.0])], "request_id long, user_id long, vector array<double>")
    got = sorted((r["request_id"], r["rank"], r["id"]) for r in search.top_k(req, items, 2, same_id=False).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (9, 1, 1), (9, 2, 1)]  # a request that is there twice has its hits twice


def test_assign_order(spark):
    items = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0])], "id long, user_id long, vector array<double>")
    spaces = spark.createDataFrame([(1, 1, [0.7, 0.714]), (2, 1, [1.0, 0.1]), (3, 2, [1.0, 0.0]), (4, 1, [0.5, 0.87])], "space_id long, user_id long, description_vector array<double>")
    got = {r["id"]: r["space_ids"] for r in classify.assign(items, spaces).collect()}
    assert got == {1: ["2", "1"]}


def test_labels(spark):
    m = spark.createDataFrame([(1, ["a"], {"a": 1}, False), (2, [], {}, True)], "memory_id long, space_ids array<string>, space_versions map<string,int>, manual_override boolean")
    new = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (1, ["c"])], "memory_id long, space_ids array<string>")
    v = spark.createDataFrame([("a", 4), ("b", 2)], "space_id string, version int")
    rows = {r["memory_id"]: r for r in membership.apply_labels(m, new, v).collect()}
    assert set(rows[1]["space_ids"]) == {"a", "b", "c"} and rows[1]["space_ids"][0] == "a" and rows[1]["space_versions"] == {"a": 4, "b": 2, "c": 1} and rows[2]["space_ids"] == ["b"]
    assert {r["memory_id"]: r["space_ids"] for r in membership.apply_labels(m, new, v, is_backfill=True).collect()}[2] == []
    gone = {r["memory_id"]: (r["space_ids"], r["space_versions"]) for r in membership.remove_label(m, "a").collect()}
    assert gone == {1: ([], {}), 2: ([], {})}
    assert {r["memory_id"]: r["space_ids"] for r in membership.remove_label(m, "absent").collect()} == {1: ["a"], 2: []}


def test_fixed_window_keys(spark):
    """Null is a key of its own, and keys above 2**53 stay apart."""
    big = 2**53
    rows = [(i, k, None if i % 2 else "x", dt.datetime(2024, 1, 1, 0, 0, i)) for i, k in enumerate([None, big, big + 1, None, big, big + 1, None, big + 1])]
    df = spark.createDataFrame(rows, "id long, key long, other string, ts timestamp_ntz")
    got = {r["id"]: (r["key"], r["hit_no"], r["allowed"]) for r in limits.fixed_window(df, "key", "ts", "id", 2, 60).collect()}
    assert got == {0: (None, 1, True), 1: (big, 1, True), 2: (big + 1, 1, True), 3: (None, 2, True), 4: (big, 2, True), 5: (big + 1, 2, True), 6: (None, 3, False), 7: (big + 1, 3, False)}
    both = limits.both_limits(df.unionAll(df), ("key", "other"), "ts", "id", 100, 60)
    assert both.count() == 16 and both.where("allowed").count() == 16


def test_graph_items(spark):
    df = spark.createDataFrame([(i, i % 2, "several interesting things together", [1.0]) for i in range(300)], "memory_id long, user_id int, text string, vector array<double>")
    few = graph.first_items(df, 1)
    assert [r["memory_id"] for r in few.collect()] == list(range(1, 201, 2)) and "vector" not in few.columns
    links = {(r["source"], r["target"]): r["weight"] for r in graph.edges(graph.extracted(few)).collect()}
    assert links == {("interesting", "together"): 100}


def test_fixed_window(spark):
    base = ts("2024-01-01")
    rows = [(i, "k", base + dt.timedelta(seconds=i)) for i in range(31)] + [(100, "k", base + dt.timedelta(seconds=60)), (200, "j", base)]
    got = {r["id"]: (r["hit_no"], r["allowed"]) for r in limits.fixed_window(spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz"), "key", "ts", "id", 30, 60).collect()}
    assert got[29] == (30, True) and got[30] == (31, False) and got[100] == (1, True) and got[200] == (1, True)


def test_codes(spark):
    now = ts(NOW)
    rows = [(1, "a", now - dt.timedelta(minutes=5), now, None), (2, "b", now - dt.timedelta(minutes=3), now + dt.timedelta(minutes=7), None), (3, "b", now - dt.timedelta(minutes=1), now + dt.timedelta(minutes=9), None), (4, "c", now, now + dt.timedelta(minutes=9), now)]
    codes = spark.createDataFrame(rows, "id long, key string, created_at timestamp_ntz, expires_at timestamp_ntz, consumed_at timestamp_ntz")
    assert [(r["key"], r["id"]) for r in limits.latest_code(codes, moment(NOW)).collect()] == [("b", 3)]
    tries = spark.createDataFrame([(1, n, n == 6) for n in range(1, 7)] + [(2, 1, True), (2, 2, True), (3, 5, True)], "code_id long, try_no int, correct boolean")
    got = {(r["code_id"], r["try_no"]): r["outcome"] for r in limits.code_attempts(tries).collect()}
    assert got[1, 5] == "wrong" and got[1, 6] == "too_many" and got[2, 1] == "ok" and got[2, 2] == "consumed" and got[3, 5] == "ok"


def test_chat_export(spark):
    msg = lambda role, *parts, kind="text": {"message": {"author": {"role": role}, "content": {"content_type": kind, "parts": list(parts)}}}
    convs = [
        {"title": "T", "mapping": {"a": msg("system", "no"), "b": msg("user", "hello", None, "there "), "c": msg("assistant", "general kenobi"), "d": msg("user", "x", kind="code"), "e": {"message": None}}},
        {"mapping": {"a": msg("user", "x" * 11)}},  # 20 characters with its label
        {"mapping": {"a": msg("user", "x" * 12)}},
        {"title": "no mapping"},
        {"title": "long", "mapping": {"a": msg("user", "y" * 9000)}},
    ]
    got = [r["text"] for r in imports.from_export(spark.createDataFrame([(json.dumps(convs),)], "raw string")).collect()]
    assert got[0] == "[T]\nUsuario: hello there\nIA: general kenobi" and got[1] == "Usuario: " + "x" * 12 and len(got[2]) == 8000 and len(got) == 3
    for bad in ("{nope", '{"title": "x"}'):
        with pytest.raises(Exception, match="array of conversations"):
            imports.from_export(spark.createDataFrame([(bad,)], "raw string")).collect()


def test_leads(spark):
    cols = "id long, email string, role string, experience string, ai_tools string, monthly_spend string, website string, referer string, accept_language string"
    rows = [(1, " A@b.co ", "r", "mid", "x", "0", "", "http://h/?utm_source=n%C3%B1", "es-AR,es"), (2, "a@B.co", "r", "mid", "x", "0", None, None, None), (3, "bad", "r", "mid", "x", "0", "", None, None), (4, "c@d.co", "r", "mid", "x", "0", "spam", None, None)]
    out = leads.deduplicated(leads.normalized(spark.createDataFrame(rows, cols), moment(NOW))).collect()
    assert [(r["id"], r["email"], r["utm_source"], r["language"]) for r in out] == [(1, "a@b.co", "nñ", "es-AR")]
    assert len(leads.sheet_rows(leads.normalized(spark.createDataFrame(rows, cols), moment(NOW))).columns) == 13


def test_relative_sizes_by_owner(spark):
    rows = [(1, "a", 4), (1, "b", 1), (2, "a", 1), (2, "b", 1), (None, "a", 3)]
    got = growth.relative_sizes(spark.createDataFrame(rows, "user_id long, id string, count long")).collect()
    assert sorted(((r["user_id"] or 0), r["id"], r["size"], r["color"]) for r in got) == [(0, "a", 1.0, 0), (1, "a", 1.0, 0), (1, "b", 0.5, 1), (2, "a", 1.0, 0), (2, "b", 1.0, 1)]


def test_revoke_and_grant(spark):
    c = spark.createDataFrame([(1, 7, False), (2, 8, False)], "id long, user_id long, revoked boolean")
    s = spark.createDataFrame([(5, 7), (6, 8)], "space_id long, user_id long")
    g = spark.createDataFrame([(1, "5")], "connection_id long, space_id string")
    new = spark.createDataFrame([(1, "5"), (1, "6"), (2, "6"), (2, "6")], "connection_id long, space_id string")
    after = access.grant(g, new, c, s)
    assert sorted(map(tuple, after.collect())) == [(1, "5"), (2, "6")]
    assert access.ungrant(after, spark.createDataFrame([(9, "9")], "connection_id long, space_id string")).count() == 2
    assert {r["id"]: r["revoked"] for r in access.revoke(c, spark.createDataFrame([(1, 7), (2, 7)], "id long, user_id long")).collect()} == {1: True, 2: False}


def test_personas(spark):
    assert personas(spark).select(F.size("memories")).distinct().collect()[0][0] == 6


def test_update_sets_nulls(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k int, v string, w string")
    delta = spark.createDataFrame([(1, None), (3, "c"), (9, "d")], "k int, v string")
    assert sorted(map(tuple, membership.update(base, delta, "k", "v").collect())) == [(1, None, "x"), (2, "b", "y"), (3, "c", "z")]


def test_listings_in_order(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5)], "id int, created_at int")
    assert [r["id"] for r in access.by_time(rows).collect()] == [3, 1, 4, 2]
    assert [r["id"] for r in access.by_time(rows, newest=False).collect()] == [1, 4, 3, 2]


def test_sheet_appends(spark, tmp_path):
    columns = schema("lead").fieldNames()
    for i in range(2):
        rows = spark.createDataFrame([tuple(f"{c}{i}" for c in columns)], schema("lead"))
        leads.append_sheet(rows, f"{tmp_path}/sheet")
    got = spark.read.option("header", True).csv(f"{tmp_path}/sheet")
    assert got.columns == columns and {r[0] for r in got.collect()} == {columns[0] + "0", columns[0] + "1"}


def test_chunk_batches_are_bounded(spark, monkeypatch):
    """What a Python worker holds does not grow with the table."""

    @F.pandas_udf("array<string>")
    def seen(x: pd.Series) -> pd.Series:
        return pd.Series([[f"{len(x)},{sum(map(len, x.dropna()))}"]] * len(x))

    monkeypatch.setattr(ingest, "_chunks", seen)
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.unset(keys[1])
        for n, size in ((3000, 5000), (600, 40_000)):
            got = [tuple(map(int, r["chunk"].split(","))) for r in ingest.chunk(spark.range(n).coalesce(1).select(F.repeat(F.lit("x"), size).alias("text"))).collect()]
            assert len(got) == n and max(r for r, _ in got) <= ingest.BATCH_ROWS and max(b for _, b in got) <= 2 * ingest.BATCH_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
