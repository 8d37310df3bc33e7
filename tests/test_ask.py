"""Decisions by models that fail now and then."""

from pyspark.sql import functions as F

from recollect.operators import ask, classify
from recollect.operators.jobs import backfill_job


def test_errors_stay_beside_their_rows(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()

        def client(prompts):
            if any(int(p) % 10 == 3 for p in prompts):
                raise OSError(f"no answer to {len(prompts)} " + "x" * 900)
            return [f"re {p}" for p in prompts]

        return client

    df = spark.range(200).select("id", F.when(F.col("id") != 7, F.col("id").cast("string")).alias("prompt"), F.lit("x").alias("reply_to")).repartition(8)
    rows = ask.asked(df, "prompt", make, batch=7, name="errors").collect()
    assert len(rows) == 200 and {r["id"] for r in rows if r["error"]} == {i for i in range(200) if i % 10 == 3}
    assert all(r["reply"] == f"re {r['id']}" for r in rows if r["id"] % 10 != 3 and r["id"] != 7) and next((r["reply"], r["error"]) for r in rows if r["id"] == 7) == (None, None)
    assert all(len(r["error"]) == 500 for r in rows if r["error"]) and len(list(tmp_path.iterdir())) <= 8  # a client a worker

    def broken():
        raise ValueError("no key")

    assert {(r["reply"], r["error"]) for r in ask.asked(df.where("id < 5"), "prompt", broken, name="broken").collect()} == {(None, "ValueError: no key")}


def tables(spark):
    spaces = spark.createDataFrame([(5, 1, [1.0, 0.0], "Work", 2, True), (6, 1, [0.8, 0.6], "Home", 1, True), (7, 1, [0.0, -1.0], "Far", 1, True)], "space_id long, user_id long, description_vector array<double>, name string, version int, reclassifying boolean")
    items = spark.createDataFrame([(i, 1, [0.8, 0.6], f"text {i}") for i in range(20)] + [(99, 1, [0.8, 0.6], None)], "id long, user_id long, vector array<double>, text string")
    return spaces, items


def test_replies_to_several_labels(spark):
    """One item in ten has no answer: its upper band stays, its error is told; the others get what is named among their candidates."""
    spaces, items = tables(spark)

    def make():
        def client(prompts):
            out = []
            for p in prompts:
                n = p.split('"')[1].removeprefix("text ")
                if n.endswith("9"):
                    raise OSError("gone")
                out.append({"0": "NINGUNO", "1": " 5 , 7,unknown", "2": "", "": "5"}.get(n, "5"))
            return out

        return client

    got = {r["id"]: (r["space_ids"], r["error"]) for r in ask.assign_asked(items, spaces, make, hi=0.9, lo=0.5).collect()}
    want = {i: (["6", "5"], None) for i in [*range(20), 99]} | {0: (["6"], None), 2: (["6"], None), 9: (["6"], "OSError: gone"), 19: (["6"], "OSError: gone")}
    assert got == want
    plain = {r["id"]: r["space_ids"] for r in classify.assign(items, spaces, 0.9, 0.5, F.lit(True)).collect()}
    assert {i: s for i, (s, _) in got.items() if s == ["6", "5"]} == {i: s for i, s in plain.items() if got[i][0] == ["6", "5"]}


def test_backfill_asks_for_each_pair(spark):
    spaces, items = tables(spark)
    memories = spark.createDataFrame([(i, [], {}, i == 4) for i in range(20)], "memory_id long, space_ids array<string>, space_versions map<string,int>, manual_override boolean")
    events = spark.createDataFrame([(100 + i, i, None) for i in range(20)], "id long, memory_id long, space_id string")
    jobs = spark.createDataFrame([(5, 1, None)], "space_id long, attempts int, error string")

    def make():
        def client(prompts):
            if any(p.split('"')[1].endswith(("8", "9")) for p in prompts):
                raise OSError("gone")
            return ["Sí, claro" if int(p.split('"')[1].removeprefix("text ") or 1) % 2 == 0 else "No" for p in prompts]

        return client

    after, stamped, _ = backfill_job(memories, events, spaces, items, jobs, hi=0.9, lo=0.5, ask=lambda pairs: ask.confirmed_pairs(pairs, items, spaces, make))
    got = {r["memory_id"] for r in after.collect() if r["space_ids"] == ["5"]}
    assert got == {i for i in range(20) if i % 2 == 0 and i % 10 not in (8, 9) and i != 4}
    assert {r["memory_id"] for r in stamped.collect() if r["space_id"] == "5"} == got


def test_yes(spark):
    rows = [("sí", True), ("SI.", True), (" Sí, claro", True), ("no", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "r string, want boolean").select(ask.yes(F.col("r")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
