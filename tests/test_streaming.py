import datetime as dt

from pyspark.sql import functions as F

from recollect.operators import limits
from recollect.operators.jobs import attempt, backfill_job
from recollect.schemas import schema
from recollect.sources import readers
from recollect.streaming import commits, jobs


def run_to_memory(df, name, mode="append", **options):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    for k, v in options.items():
        q = q.option(k, v)
    q.start().awaitTermination()


def test_ingest_stream(spark, tmp_path):
    files = spark.createDataFrame([("f1", "hello"), ("f2", "y" * 5000)], "file_id string, text string")
    new = lambda *ids: spark.createDataFrame([(i, "u", "manual") for i in ids], schema("ingest_job"))
    queue, index = f"{tmp_path}/queue", f"{tmp_path}/index"
    for ids in (("f1", "f2"), ("f2",)):  # the second time f2 again
        jobs.enqueue(new(*ids), queue)
        jobs.ingest_stream(jobs.job_queue(spark, queue, "ingest_job"), files, index, f"{tmp_path}/check").awaitTermination()
    now = jobs.current_index(spark, index)
    assert now.count() == 3 and now.select("memory_id").distinct().count() == 3


def test_index_of_files_that_change(spark, tmp_path):
    """Both streams give what the batch form gives for files that become empty, broken and whole again."""
    queue, kind = f"{tmp_path}/queue", "file_id string, text string, error string"
    none = spark.createDataFrame([], jobs.INDEX)
    index, states = none, spark.createDataFrame([], "file_id string, status string, attempts int")
    texts = [("one", "two"), ("one", None), ("", "two"), ("three", ""), (None, "four")]
    for n, (f1, f2) in enumerate(texts):
        rows = [(f, t, None if t is not None else "broken") for f, t in (("f1", f1), ("f2", f2))]
        files = spark.createDataFrame(rows, kind)
        new = spark.createDataFrame([(f, "u", "manual") for f in (("f1", "f2") if n != 3 else ("f1",))], schema("ingest_job"))
        jobs.enqueue(new, queue)
        stream = lambda: jobs.job_queue(spark, queue, "ingest_job")
        jobs.attempt_stream(stream(), files, f"{tmp_path}/i1", f"{tmp_path}/s1", f"{tmp_path}/c1").awaitTermination()
        jobs.ingest_stream(stream(), files.where("error IS NULL").select("file_id", "text"), f"{tmp_path}/i2", f"{tmp_path}/c2").awaitTermination()
        index, _ = attempt(new, files, index, states)
        index = spark.createDataFrame(index.collect(), index.schema)
        want = sorted(map(tuple, index.select("file_id", "text").collect()))
        for path in ("i1", "i2"):
            assert sorted(map(tuple, jobs.current_index(spark, f"{tmp_path}/{path}").select("file_id", "text").collect())) == want, (n, path)
    assert want == [("f2", "four")]


def test_backfill_stream_is_all_or_nothing(spark, tmp_path):
    """A batch that dies after any of its writes shows nothing; started anew it gives what the batch form gives."""
    items = spark.createDataFrame([(i, 1, [1.0, i / 10]) for i in range(8)], "id long, user_id long, vector array<double>")
    spaces = spark.createDataFrame([(5, 1, [1.0, 0.0], 2, True), (6, 1, [0.0, 1.0], 1, True)], "space_id long, user_id long, description_vector array<double>, version int, reclassifying boolean")
    memories = spark.createDataFrame([(i, [], {}, i == 0) for i in range(8)], "memory_id long, space_ids array<string>, space_versions map<string,int>, manual_override boolean")
    events = spark.createDataFrame([(100 + i, i, None) for i in range(8)], "id long, memory_id long, space_id string")
    plain = lambda df: sorted(map(repr, df.collect()))
    rows = [(5, 1, None)], [(6, 1, None)]
    ddl = "space_id long, attempts int, error string"
    want, now = [], (memories, events, spaces)
    for r in rows:
        now = backfill_job(*now, items, spark.createDataFrame(r, ddl), hi=0.95, lo=0.9)
        now = tuple(spark.createDataFrame(x.collect(), x.schema) for x in now)
        want.append([plain(x) for x in now])
    tables = {"memories": (memories, "memory_id"), "events": (events, "id"), "spaces": (spaces, "space_id")}
    seen = [[plain(x) for x in (memories, events, spaces)], *want]
    assert seen[0] != seen[1] != seen[2]
    for dies in ("memories", "events", "spaces", "commit"):
        root = f"{tmp_path}/{dies}"
        book, calls = commits.Commits(spark, f"{root}/t", tables), []

        def fail(name, dies=dies, calls=calls):
            calls.append(name)
            if name == dies:
                raise OSError("killed")

        show = lambda book=book: [plain(x) for x in (book.read()[k].select(*tables[k][0].columns) for k in ("memories", "events", "spaces"))]
        for n, r in enumerate(rows):
            spark.createDataFrame(r, ddl).write.mode("append").json(f"{root}/queue")
            start = lambda **k: commits.backfill_stream(spark.readStream.schema(ddl).json(f"{root}/queue"), book, items, f"{root}/check", hi=0.95, lo=0.9, **k)
            try:
                start(after_write=fail).awaitTermination()
            except Exception:  # the query died where it was told to
                pass
            assert dies in calls and show() == seen[n + (dies == "commit")]
            start().awaitTermination()
            assert show() == seen[n + 1]


def test_event_files(spark, tmp_path):
    """An epoch that is replayed, whole or after a task died in it, writes no line twice."""
    spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string").repartition(3).write.parquet(f"{tmp_path}/in")
    lines = readers.as_event_lines(spark.readStream.schema("id long, name string").parquet(f"{tmp_path}/in"))
    commits.write_events(lines, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    read = lambda: sorted(x for p in (tmp_path / "out").glob("*.txt") for x in p.read_text().split("\n\n") if x)
    once = read()
    assert len(once) == 20 and all(x.startswith("data: {") for x in once)
    for mark in (tmp_path / "check" / "commits").iterdir():
        mark.unlink()
    commits.write_events(lines, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert read() == once
    w = commits.EventFiles(f"{tmp_path}/own")
    assert w.open(0, 7)
    w.process({"value": "half"})
    w.close(OSError("died"))
    assert list((tmp_path / "own").iterdir()) == []
    assert w.open(0, 7)
    w.process({"value": "data: 1\n\n"})
    w.close(None)
    assert not w.open(0, 7) and [p.read_text() for p in (tmp_path / "own").iterdir()] == ["data: 1\n\n"]


def test_attempt_stream(spark, tmp_path):
    """A broken file is tried three times and fails; the others are indexed in the same batches."""
    files = spark.createDataFrame([("f1", "hello", None), ("f2", None, "broken")], "file_id string, text string, error string")
    queue, index, states = f"{tmp_path}/queue", f"{tmp_path}/index", f"{tmp_path}/states"
    seen = []
    for ids in (("f1", "f2", "gone"), ("f2",), ("f2", "f1"), ("f2",)):
        jobs.enqueue(spark.createDataFrame([(i, "u", "manual") for i in ids], schema("ingest_job")), queue)
        jobs.attempt_stream(jobs.job_queue(spark, queue, "ingest_job"), files, index, states, f"{tmp_path}/check").awaitTermination()
        seen.append({r["file_id"]: (r["status"], r["attempts"], r["error"]) for r in jobs.current_states(spark, states).collect()})
    assert [x["f2"][:2] for x in seen] == [("pending", 1), ("pending", 2), ("failed", 3), ("pending", 1)]
    assert all(x["f1"] == ("indexed", 1, None) and x["f2"][2] == "broken" and "gone" not in x for x in seen)
    assert [r["text"] for r in jobs.current_index(spark, index).collect()] == ["hello"]


def test_growth_view_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else None, base + dt.timedelta(minutes=13 * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, space_id string, created_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_to_memory(jobs.growth_view(stream), "growth_view", "complete")
    want = df.groupBy(F.window("created_at", "1 hour").alias("w"), "space_id").count().select("w.start", "space_id", "count")
    assert sorted(map(repr, map(tuple, spark.table("growth_view").collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_merged(spark, tmp_path):
    for side, n in (("a", 3), ("b", 2)):
        spark.createDataFrame([("token", str(i), None, []) for i in range(n)], schema("stream_event")).write.json(f"{tmp_path}/{side}")
    a, b = (spark.readStream.schema(schema("stream_event")).json(f"{tmp_path}/{x}") for x in "ab")
    run_to_memory(jobs.merged(a, b), "merged_events")
    assert {r["stream"]: r["count"] for r in spark.table("merged_events").groupBy("stream").count().collect()} == {"a": 3, "b": 2}


def test_limiter_equals_batch(spark, tmp_path):
    base = 1_700_000_000_000_000
    rows = [("k" if i % 2 else "j", i, base + i * 1_500_000) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, id long, us long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_to_memory(jobs.limiter_stream(stream, 10, 30, expire=False), "limited")
    hits = df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    want = {r["id"]: r["hit_no"] for r in limits.fixed_window(hits, "key", "ts", "id", 10, 30).collect()}
    assert {r["id"]: r["hit_no"] for r in spark.table("limited").collect()} == want


def test_posted_rows(spark, tmp_path):
    """Bodies that are refused or fail are kept, the others were sent."""
    spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, name string").coalesce(2).write.parquet(f"{tmp_path}/in")
    out = tmp_path / "sent"
    out.mkdir()

    def send(body: str) -> bool:
        import json

        row = json.loads(body)
        if row["id"] == 4:
            raise OSError("gone")
        if row["id"] == 5:
            return False
        (out / str(row["id"])).write_text(row["name"])
        return True

    stream = spark.readStream.schema("id long, name string").parquet(f"{tmp_path}/in")
    jobs.post_rows(stream, send, f"{tmp_path}/refused", f"{tmp_path}/check").awaitTermination()
    assert {p.name: p.read_text() for p in out.iterdir()} == {str(i): f"n{i}" for i in range(4)}
    assert sorted(r["error"] for r in spark.read.parquet(f"{tmp_path}/refused").collect()) == ["OSError: gone", "refused"]
