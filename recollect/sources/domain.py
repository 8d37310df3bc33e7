"""The domain's tables as views over the test tables, by fixed rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import load

AS_OF = "2024-01-30 23:59:59"
#: 'purchase' is left out, so that a label without a name occurs.
NAMED_SPACES = [("click", "Clicks"), ("view", "Views"), ("signup", "Signups")]
#: 'toxic' is left out, so that tags of a deleted label occur; 'unused' has no member.
MEMORY_SPACES = [("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish"), ("long", "Long texts"), ("quality", "Good texts"), ("unused", "Nothing yet")]
OWNERS, ANCHORS = 10, 20


def growth_events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("space_id"), F.col("event_id").alias("memory_id"), F.col("ts").alias("created_at"))


def named_spaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMED_SPACES, "id string, name string")


def memory_spaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMORY_SPACES, "id string, name string")


def memory_index(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    tag = lambda cond, name: F.when(cond, F.lit(name))
    ids = F.filter(F.array("lang", tag(F.col("n_chars") > 4000, "long"), tag(F.col("quality") == 1, "quality"), tag(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 50).alias("user_id"), (F.col("doc_id") % 300).alias("file_id"), ids.alias("space_ids"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("v"), (F.col("doc_id") % 11 == 0).alias("manual_override"), "source", "text",
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id DIV 2 as int), 0)").alias("created_at"),
    )
    return rows.withColumn("space_versions", F.map_from_arrays("space_ids", F.transform("space_ids", lambda _: F.col("v")))).drop("v")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Items with a vector and label ids; labels are anchors of the same owner."""
    v = load(spark, d, "embeddings")
    user = F.col("vec_id") % OWNERS
    one, two = user.cast("string"), (user + OWNERS).cast("string")
    tags = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("vec_id") % 3 == 0, F.array(one)).when(F.col("vec_id") % 3 == 1, F.array(two)).otherwise(F.array(one, two))
    return v.select(F.col("vec_id").alias("id"), user.alias("user_id"), tags.alias("space_ids"), F.col("embedding").alias("vector"))


def vector_spaces(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings").where(F.col("vec_id") < ANCHORS)
    return v.select(F.col("vec_id").alias("space_id"), (F.col("vec_id") % OWNERS).alias("user_id"), F.col("embedding").alias("description_vector"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Points that are no label's anchor."""
    return points(spark, d).where(F.col("id") >= ANCHORS)


def access_log(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("connection_id"), F.when(F.col("o_orderkey") % 2 == 0, "search").otherwise("remember").alias("action"), F.col("o_orderdate").alias("created_at"))


def connections(spark: SparkSession, d: str) -> DataFrame:
    seen = load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = load(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("label"), (F.col("c_acctbal") < 0).alias("revoked"), F.when(F.col("c_custkey") % 7 != 0, F.col("last")).alias("last_seen"))


def grants(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer"), vector_spaces(spark, d)
    return c.join(s, F.col("c_nationkey") == F.col("user_id")).where((F.col("c_custkey") + F.col("space_id")) % 3 == 0).select(F.col("c_custkey").alias("connection_id"), F.col("space_id").cast("string").alias("space_id"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations")


def files(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("user_id"), F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1).alias("name"), (F.length("html") * F.when(F.col("page_id") % 5 == 0, 977).otherwise(1)).alias("size_bytes"))


def leads(spark: SparkSession, d: str) -> DataFrame:
    """Raw form posts: padded and mixed-case addresses, every tenth repeated, a honeypot now and then."""
    c, p = load(spark, d, "customer"), load(spark, d, "pages")
    n = F.col("c_custkey")
    email = F.concat(F.replace(F.when(n % 10 == 0, F.lit("customer#repeated")).otherwise(F.lower("c_name")), F.lit("#"), F.lit(".")), F.lit("@example.com"))
    shaped = F.when(n % 3 == 0, F.upper(email)).when(n % 3 == 1, F.concat(F.lit("  "), email, F.lit(" "))).otherwise(email)
    ages = [F.lit(x) for x in ("junior", "mid", "senior", "clevel", "other")]
    page = p.select((F.col("page_id") + 1).alias("k"), F.col("url").alias("referer"))
    return c.join(page, n == F.col("k"), "left").select(
        n.alias("id"), shaped.alias("email"), F.lit("analyst").alias("role"), F.element_at(F.array(*ages), (n % 5 + 1).cast("int")).alias("experience"), F.lit("notes").alias("ai_tools"), F.lit("1-20").alias("monthly_spend"),
        F.when(n % 13 == 0, "http://bot").otherwise(" ").alias("website"), "referer", F.when(n % 2 == 0, "es-AR, es;q=0.9").alias("accept_language"),
    )


#: The same rules as DuckDB common table expressions.
SQL = {
    "growth_event": "growth_event AS (SELECT event_id AS id, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS space_id, event_id AS memory_id, ts AS created_at FROM events)",
    "named_space": "named_space(id, name) AS (VALUES ('click', 'Clicks'), ('view', 'Views'), ('signup', 'Signups'))",
    "memory_space": "memory_space(id, name) AS (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish'), ('long', 'Long texts'), ('quality', 'Good texts'), ('unused', 'Nothing yet'))",
    "memory_index": """memory_index AS (SELECT doc_id AS memory_id, doc_id % 50 AS user_id, doc_id % 300 AS file_id,
        list_filter([lang, CASE WHEN n_chars > 4000 THEN 'long' END, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS space_ids,
        CAST(doc_id % 3 + 1 AS INTEGER) AS v, doc_id % 11 = 0 AS manual_override, source, text, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id // 2 AS INTEGER)) AS created_at FROM documents LEFT JOIN labels USING (doc_id))""",
    "points": """points AS (SELECT vec_id AS id, vec_id % 10 AS user_id, CAST(embedding AS DOUBLE[]) AS vector,
        CASE WHEN vec_id % 7 = 0 THEN CAST([] AS VARCHAR[]) WHEN vec_id % 3 = 0 THEN [CAST(vec_id % 10 AS VARCHAR)] WHEN vec_id % 3 = 1 THEN [CAST(vec_id % 10 + 10 AS VARCHAR)] ELSE [CAST(vec_id % 10 AS VARCHAR), CAST(vec_id % 10 + 10 AS VARCHAR)] END AS space_ids FROM embeddings)""",
    "vector_space": "vector_space AS (SELECT vec_id AS space_id, vec_id % 10 AS user_id, CAST(embedding AS DOUBLE[]) AS description_vector FROM embeddings WHERE vec_id < 20)",
    "items": "items AS (SELECT * FROM points WHERE id >= 20)",
    "access_log": "access_log AS (SELECT o_orderkey AS id, o_custkey AS connection_id, CASE WHEN o_orderkey % 2 = 0 THEN 'search' ELSE 'remember' END AS action, o_orderdate AS created_at FROM orders)",
    "connection": "connection AS (SELECT c_custkey AS id, c_nationkey AS user_id, c_name AS label, c_acctbal < 0 AS revoked, CASE WHEN c_custkey % 7 <> 0 THEN last END AS last_seen FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey)",
    "grants": "grants AS (SELECT c_custkey AS connection_id, CAST(space_id AS VARCHAR) AS space_id FROM customer JOIN vector_space ON c_nationkey = user_id WHERE (c_custkey + space_id) % 3 = 0)",
    "files": "files AS (SELECT page_id AS id, page_id % 50 AS user_id, split_part(split_part(url, '?', 1), '/', -1) AS name, length(html) * CASE WHEN page_id % 5 = 0 THEN 977 ELSE 1 END AS size_bytes FROM pages)",
    "leads": """leads AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(e) WHEN c_custkey % 3 = 1 THEN '  ' || e || ' ' ELSE e END AS email, 'analyst' AS role,
        ['junior', 'mid', 'senior', 'clevel', 'other'][c_custkey % 5 + 1] AS experience, 'notes' AS ai_tools, '1-20' AS monthly_spend, CASE WHEN c_custkey % 13 = 0 THEN 'http://bot' ELSE ' ' END AS website, url AS referer,
        CASE WHEN c_custkey % 2 = 0 THEN 'es-AR, es;q=0.9' END AS accept_language
        FROM (SELECT *, replace(CASE WHEN c_custkey % 10 = 0 THEN 'customer#repeated' ELSE lower(c_name) END, '#', '.') || '@example.com' AS e FROM customer) LEFT JOIN pages ON page_id + 1 = c_custkey)""",
}
NEEDS = {"grants": ("vector_space",), "items": ("points",)}


def prelude(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named views and what they build on."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in order)
