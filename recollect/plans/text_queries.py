"""Text, chunking, import, limit and lead queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.times import countdown, hour_label, moment
from ..operators import imports as im
from ..operators import ingest as ing
from ..operators import leads as le
from ..operators import limits as li
from ..sources import domain as dom
from ..sources.readers import as_event_lines, load


def now():
    return moment(dom.AS_OF)


def hits(s, d):
    return load(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts"))


def _marked(s, d):
    """Documents with line ends and blank lines that the tables lack."""
    return load(s, d, "documents").select("doc_id", F.concat(F.lit(" \t"), F.regexp_replace("text", "\n", F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\n\n\n\n").otherwise("\n")), F.lit("\n ")).alias("text"))


def _chunked(s, d, whole=False):
    return ing.chunk(_marked(s, d), whole=whole)


def _tries(s, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return load(s, d, "lineitem").select(F.col("l_orderkey").alias("code_id"), F.row_number().over(order).alias("try_no"), (F.col("l_quantity") > 40).alias("correct"))


def _leads(s, d):
    return le.normalized(dom.leads(s, d), now())


def _export(s, d):
    turns = load(s, d, "conversations")
    message = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text", F.lit("")).alias("parts")).alias("content"))
    nodes = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(message.alias("message")).alias("n")))).alias("x"))
    mapping = F.map_from_arrays(F.transform("x", lambda e: e["turn"].cast("string")), F.transform("x", lambda e: e["n"]))
    raw = nodes.select(F.to_json(F.array(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("title"), mapping.alias("mapping")))).alias("raw"))
    return im.from_export(raw)


QUERIES = {
    "normalize_text": lambda s, d: _marked(s, d).select("doc_id", t.normalize_text(F.col("text")).alias("text")),
    "chunk_documents": lambda s, d: _chunked(s, d).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest")),
    "chunk_stats": lambda s, d: _chunked(s, d, whole=True).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars")),
    "import_conversations": lambda s, d: im.from_turns(dom.conversations(s, d)),
    "import_export_json": _export,
    "last_user_message": lambda s, d: im.last_user_message(dom.conversations(s, d)),
    "merged_events": lambda s, d: im.merged_events(hits(s, d).where("id % 2 = 0"), hits(s, d).where("id % 2 = 1")).select("id", "stream"),
    "rate_limit_sliding": lambda s, d: li.sliding_window(hits(s, d), "key", "ts", 3, 86400).select("id", "hits", "allowed"),
    "rate_limit_fixed": lambda s, d: li.fixed_window(hits(s, d), "key", "ts", "id", 3, 86400),
    "otp_request_limits": lambda s, d: li.both_limits(hits(s, d).withColumn("ip", F.col("id") % 97), ("key", "ip"), "ts", "id", 3, 86400),
    "stream_counts": lambda s, d: load(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("calls"), F.count("*").alias("all_events")),
    "event_lines": lambda s, d: as_event_lines(load(s, d, "nation").select("n_nationkey", "n_name")),
    "otp_attempts": lambda s, d: li.code_attempts(_tries(s, d)),
    "leads_normalized": _leads,
    "leads_dedup": lambda s, d: le.deduplicated(_leads(s, d), dom.leads(s, d).where("id % 7 = 0")).select("id", "email"),
    "lead_sheet": lambda s, d: le.sheet_rows(_leads(s, d)),
    "utm_fields": lambda s, d: load(s, d, "pages").select("page_id", *[t.utm(F.col("url"), f).alias(f) for f in ("utm_source", "utm_medium", "utm_campaign")]),
    "format_bytes": lambda s, d: dom.files(s, d).select("id", t.format_bytes(F.col("size_bytes")).alias("size")),
    "ellipsis": lambda s, d: load(s, d, "part").select("p_partkey", t.ellipsis(F.col("p_name")).alias("short")),
    "ext_of_name": lambda s, d: dom.files(s, d).select("id", t.extension(F.col("name")).alias("ext")),
    "query_marks": lambda s, d: load(s, d, "customer").select("c_custkey", t.query_mark(F.concat("c_name", F.lit(" "), F.repeat("c_mktsegment", 8))).alias("mark"), t.token_key(F.col("c_name")).alias("token_key")),
    "small_texts": lambda s, d: load(s, d, "events").select("event_id", t.digits_only(F.col("props")).alias("digits"), hour_label(F.col("ts")).alias("hour"), t.signed(F.floor("value").cast("long") - 50).alias("signed"), t.pad2(F.hour("ts")).alias("padded")),
    "countdowns": lambda s, d: load(s, d, "events").select("event_id", countdown(now(), F.col("ts")).alias("c")).select("event_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("days", "hours", "minutes", "seconds")]),
    "status_labels": lambda s, d: load(s, d, "orders").select("o_orderkey", t.labelled(F.col("o_orderstatus"), {"O": "Pendiente", "F": "Indexado"}, "Error").alias("label")),
    "last_break": lambda s, d: load(s, d, "documents").select("doc_id", t.last_index(F.col("text"), "\n").cast("long").alias("at")),
    "progress": lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", ing.progress(F.col("l_linenumber"), F.lit(7)).alias("percent")),
}

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279)"
NORMAL = f"trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS t"
_NORM = f"""marked AS (SELECT doc_id, ' ' || chr(9) || replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN repeat(chr(10), 4) ELSE chr(10) END) || chr(10) || ' ' AS text FROM documents),
norm AS (SELECT doc_id, {NORMAL} FROM marked)"""
def chunks_sql(norm: str, most: int | None = 200) -> str:
    """Where the chunker's loop starts and stops each piece of norm(doc_id, t), the first ``most`` or all, as a recursive query."""
    return f"""WITH RECURSIVE {norm}, texts AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n FROM norm WHERE t <> ''),
cut(doc_id, t, n, a, e, no) AS (SELECT doc_id, t, n, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM texts UNION ALL
  SELECT doc_id, t, n, CASE WHEN stop = n THEN n WHEN stop = hard THEN stop ELSE greatest(stop - 400, a + 1) END, stop, no + 1 FROM (
    SELECT *, CASE WHEN n <= 4000 OR hard = n THEN n WHEN p2 > 2000 THEN a + p2 WHEN p1 > 2000 THEN a + p1 ELSE hard END AS stop FROM (
      SELECT *, CASE WHEN contains(s, chr(10) || chr(10)) THEN length(s) - 2 - (strpos(reverse(s), chr(10) || chr(10)) - 1) ELSE -1 END AS p2, CASE WHEN contains(s, chr(10)) THEN length(s) - 1 - (strpos(reverse(s), chr(10)) - 1) ELSE -1 END AS p1 FROM (
        SELECT doc_id, t, n, a, no, least(a + 4000, n) AS hard, substr(t, a + 1, least(a + 4000, n) - a) AS s FROM cut WHERE a < n{'' if most is None else f' AND no < {most}'})))),
pieces AS (SELECT c.doc_id, c.no - 1 AS k, trim(substr(c.t, p.a + 1, c.e - p.a), {WS}) AS chunk FROM cut c JOIN cut p ON p.doc_id = c.doc_id AND p.no = c.no - 1 WHERE c.no > 0),
chunked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_no, chunk FROM pieces WHERE chunk <> '')
"""


_CHUNKS = chunks_sql(_NORM)
_SAID = f"""lines AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Usuario' ELSE 'IA' END || ': ' || trim(text, {WS}) AS line FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, {WS}) <> '')"""
_UTM = ", ".join(f"url_decode(replace(coalesce(regexp_extract(url, '[?&]{f}=([^&#]*)', 1), ''), '+', ' ')) AS {f}" for f in ("utm_source", "utm_medium", "utm_campaign"))
_LEADS = dom.prelude("leads") + f""", normal AS (SELECT id, '2024-01-30T23:59:59.000Z' AS created_at, lower(trim(email, {WS})) AS email, role, experience, ai_tools, monthly_spend, 'landing-v3' AS source, coalesce(referer, '') AS referer, '' AS user_agent,
  coalesce(trim(split_part(accept_language, ',', 1)), '') AS language, {_UTM} FROM (SELECT *, coalesce(referer, '') AS url FROM leads) WHERE trim(website) = '' AND experience <> 'other')"""
_S = "date_diff('second', ts, TIMESTAMP '2024-01-30 23:59:59')"
def fixed_sql(name: str, key: str) -> str:
    return f"""{name}e AS (SELECT event_id AS id, {key} AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS r FROM events),
 {name}(id, key, r, s, no) AS (SELECT id, key, r, us, 1::BIGINT FROM {name}e WHERE r = 1 UNION ALL SELECT e.id, e.key, e.r, CASE WHEN e.us >= s + 86400000000 THEN e.us ELSE s END, CASE WHEN e.us >= s + 86400000000 THEN 1 ELSE no + 1 END FROM {name} f JOIN {name}e e ON e.key = f.key AND e.r = f.r + 1)"""


ORACLE_SQL = {
    "otp_request_limits": f"WITH RECURSIVE {fixed_sql('a', 'user_id')}, {fixed_sql('b', 'event_id % 97')} SELECT a.id, a.no <= 3 AND b.no <= 3 AS allowed FROM a JOIN b ON a.id = b.id",
    "stream_counts": "SELECT user_id, count(*) FILTER (event_type = 'click') AS calls, count(*) AS all_events FROM events GROUP BY 1",
    "event_lines": """SELECT 'data: {"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10) || chr(10) AS value FROM nation""",
    "normalize_text": f"WITH {_NORM} SELECT doc_id, t AS text FROM norm",
    "chunk_documents": _CHUNKS + "SELECT doc_id, chunk_no, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest FROM chunked",
    "chunk_stats": chunks_sql(_NORM, None) + "SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM chunked GROUP BY 1",
    "import_conversations": f"WITH {_SAID}, w AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM lines GROUP BY 1) SELECT conv_id, substr(text, 1, 8000) AS text FROM w WHERE length(text) > 20",
    "last_user_message": "SELECT conv_id, arg_max(text, turn) AS last_message FROM conversations WHERE role = 'user' GROUP BY 1",
    "merged_events": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS stream FROM events",
    "rate_limit_sliding": "SELECT event_id AS id, count(*) OVER w AS hits, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)",
    "rate_limit_fixed": f"WITH RECURSIVE {fixed_sql('a', 'user_id')} SELECT id, key, no AS hit_no, no <= 3 AS allowed FROM a",
    "otp_attempts": """WITH t AS (SELECT l_orderkey AS code_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS try_no, l_quantity > 40 AS ok FROM lineitem)
 SELECT code_id, try_no, CASE WHEN coalesce(max(CASE WHEN ok AND try_no <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY code_id ORDER BY try_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'consumed' WHEN try_no > 5 THEN 'too_many' WHEN ok THEN 'ok' ELSE 'wrong' END AS outcome FROM t""",
    "leads_normalized": _LEADS + " SELECT * FROM normal",
    "leads_dedup": _LEADS + f", known AS (SELECT DISTINCT lower(trim(email, {WS})) AS email FROM leads WHERE id % 7 = 0) SELECT min(id) AS id, email FROM normal WHERE email NOT IN (SELECT email FROM known) GROUP BY email",
    "lead_sheet": _LEADS + " SELECT * EXCLUDE (id) FROM normal",
    "utm_fields": f"SELECT page_id, {_UTM} FROM pages",
    "format_bytes": dom.prelude("files") + " SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN CAST(floor(size_bytes / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB' ELSE CAST(floor(size_bytes * 10 / 1048576.0::DOUBLE + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(size_bytes * 10 / 1048576.0::DOUBLE + 0.5) AS BIGINT) % 10 || ' MB' END AS size FROM files",
    "ellipsis": "SELECT p_partkey, CASE WHEN length(p_name) > 18 THEN substr(p_name, 1, 16) || '…' ELSE p_name END AS short FROM part",
    "ext_of_name": dom.prelude("files") + " SELECT id, CASE WHEN split_part(name, '.', -1) = '' THEN 'bin' ELSE split_part(name, '.', -1) END AS ext FROM files",
    "query_marks": "SELECT c_custkey, substr(to_base64(encode(c_name || ' ' || repeat(c_mktsegment, 8))), 1, 64) AS mark, substr(replace(translate(to_base64(unhex(sha256(c_name))), '+/', '-_'), '=', ''), 1, 32) AS token_key FROM customer",
    "small_texts": "SELECT event_id, regexp_replace(props, '[^0-9]', '', 'g') AS digits, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || 'h' AS hour, CASE WHEN CAST(floor(value) AS BIGINT) - 50 > 0 THEN '+' ELSE '' END || (CAST(floor(value) AS BIGINT) - 50) AS signed, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS padded FROM events",
    "countdowns": "WITH x AS (SELECT event_id, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 23:59:59') - epoch_us(ts)) / 1000000) AS BIGINT)) AS s FROM events) SELECT event_id, s // 86400 AS days, s % 86400 // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds FROM x",
    "status_labels": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Pendiente' WHEN 'F' THEN 'Indexado' ELSE 'Error' END AS label FROM orders",
    "last_break": "SELECT doc_id, CAST(CASE WHEN contains(text, chr(10)) THEN length(text) - strpos(reverse(text), chr(10)) ELSE -1 END AS BIGINT) AS at FROM documents",
    "progress": "SELECT l_orderkey, l_linenumber, CAST(floor(l_linenumber / 7.0::DOUBLE * 90 + 0.5) AS INTEGER) AS percent FROM lineitem",
}
ORACLE_SQL["import_export_json"] = f"""WITH lines AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Usuario' ELSE 'IA' END || ': ' || trim(text, {WS}) AS line FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, {WS}) <> ''),
 w AS (SELECT 'c' || conv_id AS title, '[c' || conv_id || ']' || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS text FROM lines GROUP BY conv_id) SELECT title, substr(text, 1, 8000) AS text FROM w WHERE length(text) > 20"""
