"""Keyed state over streams against batch forms and plain folds, with rows out of order and a restart in mid-stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from recollect.operators import limits
from recollect.schemas import schema
from recollect.streaming import stateful

BASE = 1_700_000_000_000_000


@pytest.fixture(autouse=True)
def store(spark):
    stateful.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, batches, ddl, make):
    """The rows that ``make(stream)`` gives for batches of rows; the query is stopped and started anew after each file."""
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(ddl).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out).collect(), check


def shuffled(rows, size, spread, rng):
    """Batches of rows (time first) that arrive up to ``spread`` places off."""
    order = sorted(range(len(rows)), key=lambda i: i + rng.random() * spread)
    return [[rows[i] for i in order[k : k + size]] for k in range(0, len(rows), size)]


def test_both_limits_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(BASE + i * 7_000_000, i, rng.choice("abc"), rng.choice("xy") if i % 9 else None) for i in range(90)]
    ddl = "us long, id long, email string, ip string"
    batches = shuffled(rows, 30, 5, rng) + [[(BASE + 10**10, 10**6, "later", "later")], [(BASE + 2 * 10**10, 10**6 + 1, "later", "later")]]
    got, check = streamed(spark, tmp_path, batches, ddl, lambda s: stateful.all_limits(s, ("email", "ip"), 5, 120, "2 minutes"))
    hits = spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    want = {r["id"]: r["allowed"] for r in limits.both_limits(hits, ("email", "ip"), "ts", "id", 5, 120).collect()}
    found = {r["id"]: r["allowed"] for r in got if r["id"] < 10**6}
    assert found == want and len(got) - len(found) <= 1 and set(want.values()) == {True, False}
    kept = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "state").load(check)
    assert {r["key"]["key"] for r in kept.collect()} <= {"later"}  # the others' state is gone with their windows


def plain_outcomes(events, minutes=10, tries=5):
    codes, out = {}, {}
    for us, number, kind, key, code in sorted(events):
        mine = codes.setdefault(key, [])
        if kind == "issue":
            mine.append([us, code, 0, False])
            continue
        live = [c for c in mine if not c[3] and c[0] + minutes * 60_000_000 > us]
        if not live:
            out[number] = "none"
            continue
        c = live[-1]
        c[2] += 1
        out[number] = "too_many" if c[2] > tries else "ok" if c[1] == code else "wrong"
        c[3] = out[number] == "ok"
    return out


def test_codes_by_plain_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = [(BASE + i * 20_000_000, i, "issue" if rng.random() < 0.15 else "try", rng.choice(["k", "l", None]), rng.choice("123456")) for i in range(140)]
    ddl = "us long, id long, kind string, key string, code string"
    batches = shuffled(rows, 50, 4, rng) + [[(BASE + 10**11, 9999, "try", "later", "1")]] * 2
    got, check = streamed(spark, tmp_path, batches, ddl, lambda s: stateful.code_outcomes(s, late="5 minutes"))
    found, want = {r["id"]: r["outcome"] for r in got if r["id"] != 9999}, plain_outcomes(rows)
    assert sorted(want.items() ^ found.items()) == [] and set(want.values()) == {"none", "ok", "wrong", "too_many"}
    kept = spark.read.format("statestore").option("stateVarName", "state").load(check)
    assert kept.count() == 0


def test_events_over_chunk_borders(spark, tmp_path):
    """Any cutting, also inside a character or a blank line, and chunks out of order give the same events."""
    rng = random.Random(6)
    events = [{"type": "plain_delta", "delta": f"añ€😀 {i}"} for i in range(12)]
    import json

    raw = ("".join(f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events) + ": note\n\n" + "data: {\"type\": \"unfinished").encode()
    rows = []
    for c in range(4):
        at = sorted(rng.sample(range(1, len(raw)), 5 + 30 * c))
        rows += [(f"c{c}", k, raw[a:b]) for k, (a, b) in enumerate(zip([0, *at], [*at, len(raw)], strict=True))]
    rng.shuffle(rows)
    rows.append(rows[0])  # a chunk that came twice
    got, _ = streamed(spark, tmp_path, [rows[:60], rows[60:120], rows[120:]], "connection string, seq long, data binary", stateful.chunked_events)
    for c in range(4):
        assert [r["delta"] for r in sorted((r for r in got if r["connection"] == f"c{c}"), key=lambda r: r["n"])] == [e["delta"] for e in events]


def test_answers_end_once(spark, tmp_path):
    """Order inside each side, one closing event, also after an error of either side; nothing after it."""
    rng = random.Random(7)
    rows, want = [], {}
    for s in range(9):
        a = [("plain_delta", f"a{i}", None, None) for i in range(rng.randrange(4))]
        b = [("memory_delta", f"b{i}", None, None) for i in range(rng.randrange(4))]
        told_a, told_b, tools = list(a), list(b), []
        if s % 3 == 1:
            a.append(("error", None, None, None))
            told_a += [("plain_delta", stateful.ERROR_TEXT, None, None), ("plain_done", None, None, None)]
        else:
            a.append(("plain_done", None, None, None))
            told_a.append(a[-1])
        if s % 3 == 2:
            b.append(("error", None, None, None))
            told_b.append(("memory_delta", stateful.ERROR_TEXT, None, None))
        else:
            tools = [f"tool{s}", "search"]
            b.append(("memory_done", None, None, tools))
        if s == 8:  # the second answer is still under way
            b.pop()
            told_b.pop() if told_b and told_b[-1][1] == stateful.ERROR_TEXT else None
        b += [("memory_delta", "too late", None, None)] if s < 8 else []
        rows += [(f"s{s}", side, k, *e) for side, x in (("a", a), ("b", b)) for k, e in enumerate(x)]
        want[f"s{s}"] = (told_a, told_b, tools if s != 8 else None)
    rng.shuffle(rows)
    ddl = "session string, stream string, seq long, type string, delta string, name string, tool_calls array<string>"
    got, _ = streamed(spark, tmp_path, [rows[:20], rows[20:35], [*rows[35:], rows[0]]], ddl, stateful.merged_answers)
    for s, (a, b, tools) in want.items():
        mine = [(r["type"], r["delta"], r["name"], r["tool_calls"]) for r in sorted((r for r in got if r["session"] == s), key=lambda r: r["n"])]
        assert [e for e in mine if e[0].startswith("plain")] == a and [e for e in mine if e[0].startswith("memory")] == b
        assert [e for e in mine if e[0] == "done"] == ([("done", None, None, tools)] if tools is not None else []) and (tools is None or mine[-1][0] == "done")


def test_jobs_try_again(spark, tmp_path):
    """One job works at once, one fails twice and is indexed by its third try, one fails for good; nobody queues them again."""
    (tmp_path / "tries").mkdir()
    folder = str(tmp_path / "tries")

    def work(file_id: str) -> str:
        import os
        import uuid

        open(f"{folder}/{file_id}-{uuid.uuid4().hex}", "w").close()
        n = sum(f.startswith(f"{file_id}-") for f in os.listdir(folder))
        if file_id == "bad" or file_id == "slow" and n < 3:
            raise OSError("gone " + "x" * 900)
        return f"text of {file_id}"

    spark.createDataFrame([(i, "u", "manual") for i in ("good", "slow", "bad")], schema("ingest_job")).write.json(f"{tmp_path}/queue")
    stream = stateful.tried_jobs(spark.readStream.schema(schema("ingest_job")).json(f"{tmp_path}/queue"), work, first_delay=0.2)
    q = stream.writeStream.format("memory").queryName("tried").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="100 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("tried").where("status <> 'pending'").count() < 3:
            assert q.isActive, q.exception()
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.table("tried").collect()
    last = {r["file_id"]: (r["status"], r["attempts"], r["text"]) for r in sorted(rows, key=lambda r: r["attempts"])}
    assert last == {"good": ("indexed", 1, "text of good"), "slow": ("indexed", 3, "text of slow"), "bad": ("failed", 3, None)}
    assert len(rows) == 7 and all(len(r["error"]) == 500 for r in rows if r["error"])
