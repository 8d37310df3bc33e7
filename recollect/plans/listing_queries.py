"""Ordered listings, seed rows, files by type, issued secrets and small functions of the domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.times import day_label
from ..operators import access as a
from ..operators import cluster as c
from ..operators import membership as m
from ..operators.limits import expiry
from ..sources import domain as dom
from ..sources.personas import SEED, personas
from ..sources.readers import content_or_placeholder, event_lines, load, parsed

ANSWERS = ("SÍ, claro", "  si ", "NO", "Sino", "")
SHEETS = ("Leads 2024!A:M", "'Mine'!B:B", "O'Neil", "")


def _pick(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _listed_connections(s, d):
    first = load(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    return a.by_time(dom.connections(s, d).join(first, "id", "left").select("id", "label", "created_at"))


def _listed_spaces(s, d):
    rows = dom.growth_events(s, d).where("space_id IS NOT NULL").groupBy("space_id").agg(F.min("created_at").alias("created_at"))
    return a.by_time(rows, newest=False, id_col="space_id")


def _persona_of_customers(s, d):
    """Customers by a persona's id; every seventh names one that does not exist."""
    p = personas(s).select("id", "name")
    asked = load(s, d, "customer").select("c_custkey", F.concat(F.lit("p"), F.col("c_custkey") % 7).alias("id"))
    return asked.join(F.broadcast(p), "id").select("c_custkey", F.col("name").alias("persona"))  # six rows


def _parsed_files(s, d):
    """Pages by type: a text's bytes, a picture, no type at all, and a text whose object is missing."""
    n = F.col("page_id") % 4
    files = load(s, d, "pages").select("page_id", F.when(n == 1, "image/png").when(n != 2, "text/csv").alias("mime"), F.when(n != 3, F.encode("html", "UTF-8")).alias("content"))
    p = parsed(F.col("content"), F.col("mime"))
    text = F.when(p["error"].isNull(), content_or_placeholder(p["text"], F.concat(F.lit("page "), F.col("page_id"))))
    return files.select("page_id", text.alias("text"), p["error"].alias("error"))


def _domain_functions(s, d):
    n = F.col("c_custkey")
    raw = F.when(n % 2 == 0, F.concat(F.lit('{"n":'), n, F.lit("}"))).otherwise("{broken")
    sheet = _pick(SHEETS, n)
    return load(s, d, "customer").select("c_custkey", t.says_yes(_pick(ANSWERS, n)).alias("yes"), t.quote_sheet(sheet).alias("quoted"), t.email_column_range(sheet).alias("emails"), t.parsed_json(raw, "n long", F.struct(F.lit(-1).cast("long").alias("n")))["n"].alias("n"))


def _moments(s, d):
    return load(s, d, "events").select("event_id", expiry(F.col("ts")).alias("expires_at"), day_label(F.col("ts")).alias("label"))


def _read_events(s, d):
    """Lines of a stream as they come, of which only those with data count."""
    turns = load(s, d, "conversations")
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("delta"))))
    lines = turns.select(F.explode(F.array(F.lit(": ping"), line, F.lit(""), F.lit("data: broken"))).alias("value"))
    return event_lines(lines).where("type IS NOT NULL").select("type", "delta")


def _issued(s, d):
    """What can be told of random values: how many there are, how many differ, and their form."""
    made = load(s, d, "customer").select(t.secret_token(F.col("c_custkey"), "t_").alias("token"), t.one_time_code(F.col("c_custkey")).alias("code"))
    form = made.select("token", (F.col("token").rlike("^t_[A-Za-z0-9_-]{43}$") & F.col("code").rlike("^[1-9][0-9]{5}$")).alias("fits"))
    return form.agg(F.count("*").alias("issued"), F.count_distinct("token").alias("different"), F.count_if("fits").alias("fit"))


def _cleared(s, d):
    """Every second order's priority is set to null, every other fourth's to a new one."""
    base = load(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    delta = base.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "new").alias("o_orderpriority"))
    return m.update(base, delta, "o_orderkey", "o_orderpriority")


def _spread(s, d):
    """Weights of all items by their owner's anchors."""
    spaces = dom.vector_spaces(s, d).select("user_id", F.col("space_id").alias("cluster"), F.col("description_vector").alias("centroid"))
    return c.spread_weights(dom.items(s, d), spaces).select("id", F.round("weight", 4).alias("weight"))


QUERIES = {
    "listed_connections": _listed_connections,
    "listed_spaces": _listed_spaces,
    "persona_lookup": _persona_of_customers,
    "parsed_files": _parsed_files,
    "domain_functions": _domain_functions,
    "moments": _moments,
    "read_event_lines": _read_events,
    "issued_secrets": _issued,
    "update_to_null": _cleared,
    "spread_weights": _spread,
}


def _picked(names, n):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + f"][{n} % {len(names)} + 1]"


def _quoted(x):
    return f"CASE WHEN starts_with({x}, '''') AND ends_with({x}, '''') THEN {x} ELSE '''' || replace({x}, '''', '''''') || '''' END"


ORACLE_SQL = {
    "listed_connections": "SELECT c_custkey AS id, c_name AS label, min(o_orderdate) AS created_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY 3 DESC NULLS LAST, 1",
    "listed_spaces": dom.prelude("growth_event") + " SELECT space_id, min(created_at) AS created_at FROM growth_event WHERE space_id IS NOT NULL GROUP BY 1 ORDER BY 2, 1",
    "persona_lookup": f"WITH p(id, name) AS (VALUES {', '.join(f"('{r[0]}', '{r[1]}')" for r in SEED)}) SELECT c_custkey, name AS persona FROM customer JOIN p ON id = 'p' || (c_custkey % 7)",
    "parsed_files": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 3 THEN '[file: page ' || page_id || ']' END AS text, CASE page_id % 4 WHEN 1 THEN 'unsupported type: image/png' WHEN 2 THEN 'unsupported type: null' END AS error FROM pages",
    "domain_functions": f"""WITH x AS (SELECT c_custkey, upper(trim({_picked(ANSWERS, 'c_custkey')})) AS u, {_picked(SHEETS, 'c_custkey')} AS s FROM customer),
 q AS (SELECT *, trim(s) AS whole, trim(split_part(s, '!', 1)) AS tab FROM x)
 SELECT c_custkey, starts_with(u, 'SÍ') OR starts_with(u, 'SI') AS yes, {_quoted('whole')} AS quoted, {_quoted('tab')} || '!B:B' AS emails, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS BIGINT) ELSE -1 END AS n FROM q""",
    "moments": "SELECT event_id, ts + INTERVAL 10 MINUTE AS expires_at, ['lun', 'mar', 'mié', 'jue', 'vie', 'sáb', 'dom'][isodow(ts)] || ', ' || day(ts) AS label FROM events",
    "read_event_lines": "SELECT role AS type, text AS delta FROM conversations",
    "issued_secrets": "SELECT count(*) AS issued, count(*) AS different, count(*) AS fit FROM customer",
    "update_to_null": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders",
    "spread_weights": dom.prelude("items", "vector_space") + """, s AS (SELECT id, max(round(list_dot_product(vector, description_vector), 6)) AS sim FROM items JOIN vector_space USING (user_id) GROUP BY 1)
 SELECT id, round((1 - sim) * (1 - sim), 4) AS weight FROM s""",
}
