"""Registered queries over all rows: brute force on fixtures. Their SQL, in test_oracle, has no cuts."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from recollect.plans import registry

SF = "/root/testdata/sf0.001"


def test_import_whole_conversations(spark, tmp_path):
    """Turns from the hundredth on and the tails of long turns are imported."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(150)]
    rows += [(2, 0, "user", "word " * 100 + "tail"), (2, 1, "system", "not said"), (2, 2, "assistant", "x" * 9000), (3, 0, "user", "  ")]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))), str(tmp_path / "conversations.parquet"))
    want = {}
    for conv, _, role, text in sorted(rows):
        if role in ("user", "assistant") and text.strip():
            want.setdefault(f"c{conv}", [f"[c{conv}]"]).append(f"{'Usuario' if role == 'user' else 'IA'}: {text.strip()}")
    got = {r["title"]: r["text"] for r in registry.QUERIES["import_export_json"](spark, str(tmp_path)).collect()}
    assert got == {k: "\n".join(v)[:8000] for k, v in want.items()}
    assert "turn 149" in got["c1"] and "tail" in got["c2"] and len(got["c2"]) == 8000


def test_chunk_stats_reads_to_the_end(spark, tmp_path):
    """Texts of more than 200 pieces count whole, with and without soft breaks, like the SQL says."""
    texts = {3: "x" * 808_001, 1: ("line of text " * 230 + "\n") * 260, 2: "short", 4: "  ", 5: None}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}), str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r[c] for c in ("doc_id", "chunks", "chars")) for r in registry.QUERIES["chunk_stats"](spark, str(tmp_path)).collect())
    d = duckdb.connect()
    d.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert got == sorted(d.sql(registry.ORACLE_SQL["chunk_stats"]).fetchall())
    assert got[2] == (3, 203, 808_001) and got[0][1] > 200 and got[0][2] > len(texts[1].strip()) and got[1] == (2, 1, 5)


def test_every_live_connection_asks(spark):
    live = spark.read.parquet(f"{SF}/customer.parquet").where("c_acctbal >= 0").count()
    assert registry.QUERIES["clamped_labels"](spark, SF).count() == registry.QUERIES["audit_rows"](spark, SF).count() == registry.QUERIES["token_resolution"](spark, SF).count() == live


def test_suggestions_of_every_owner(spark):
    rows = registry.QUERIES["suggest_spaces"](spark, SF).collect()
    owners = {r["user_id"] for r in registry.QUERIES["suggest_k"](spark, SF).collect()}
    assert len(owners) > 1 and {r["user_id"] for r in rows} == owners
    assert all(int(i.removeprefix("memory number")) % 10 == r["user_id"] for r in rows for i in r["examples"].split("|"))
