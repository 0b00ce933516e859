"""Queries over event logs, orders, embeddings, conversations; streams and sinks."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom import binding as B
from marketloom.functions import text as T
from marketloom.functions import vectors as V
from marketloom.operators import activity, admission, deltas, extraction, grounding, matrix, nearest, skew, training
from marketloom.operators import vectors as vec
from marketloom.plans.registry import query
from marketloom.session import scratch_path
from marketloom.sources import sinks, tables
from marketloom.sources.tables import table
from marketloom.streaming import streams

def is_error():
    return F.col("event_type") == "error"



def _events(spark, folder):
    return table(spark, folder, "events")


# ------------------------------------------------------------------ windows
LAST_SQL = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events"


@query("h1_last_actions", f"SELECT user_id, event_id, CAST(age AS BIGINT) AS age FROM ({LAST_SQL}) WHERE age <= 20")
def last_actions(spark, folder):
    return activity.last_n(_events(spark, folder), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", F.col("age").cast("bigint").alias("age")
    )


@query(
    "h2_last_errors",
    f"""SELECT user_id, event_id, CAST(r AS BIGINT) AS error_age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY age) AS r
        FROM ({LAST_SQL}) WHERE age <= 20 AND event_type = 'error') WHERE r <= 3""",
)
def last_errors(spark, folder):
    rows = activity.last_errors(_events(spark, folder), "user_id", ["ts", "event_id"], is_error(), 3)
    return rows.select("user_id", "event_id", F.col("error_age").cast("bigint").alias("error_age"))


@query(
    "h3_context_text",
    f"""SELECT c_custkey AS user_id, CASE WHEN count(event_id) = 0 THEN 'No recent actions recorded.' ELSE 'Recent pipeline actions:' || chr(10) ||
          string_agg('  ' || CASE WHEN event_type = 'error' THEN '❌' ELSE '✅' END || ' [' || event_type || '] ' || props ||
            CASE WHEN event_type = 'error' THEN ' — Error: ' || value ELSE '' END, chr(10) ORDER BY age DESC) END AS context
        FROM customer LEFT JOIN (SELECT * FROM ({LAST_SQL}) WHERE age <= 5) ON c_custkey = user_id GROUP BY 1""",
)
def context_text(spark, folder):
    events = _events(spark, folder).select(
        "user_id", "ts", "event_id", "event_type", F.col("event_type").alias("agent"), F.col("props").alias("action"),
        F.when(is_error(), F.col("value").cast("string")).alias("error"),
    )
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return activity.context_text(users, events, "user_id", ["ts", "event_id"], is_error(), 5)


@query(
    "h5_latest_records",
    """SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 5""",
)
def latest_records(spark, folder):
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return skew.top_n(table(spark, folder, "orders"), ["o_custkey"], newest, 5).select(
        "o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank")
    )


STREAK_SQL = """
g AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
health AS (SELECT event_id, user_id, ts, CAST(count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS BIGINT) AS consecutive_failures FROM g)
"""


@query("h7_health", f"WITH {STREAK_SQL} SELECT event_id, user_id, consecutive_failures, consecutive_failures < 3 AS healthy FROM health")
def health(spark, folder):
    return activity.health(_events(spark, folder), "user_id", is_error()).select(
        "event_id", "user_id", "consecutive_failures", "healthy"
    )


# one event after another: a skipped event leaves the state as it is
@query(
    "h8_domain_breaker",
    """WITH RECURSIVE n AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       walk AS (
         SELECT event_id, user_id, i, failed::INT AS streak, CAST(NULL AS TIMESTAMP) AS opened_at, false AS skipped, CAST(NULL AS TIMESTAMP) AS opened, ts FROM n WHERE i = 1
         UNION ALL
         SELECT event_id, user_id, i, CASE WHEN skipped THEN streak WHEN failed THEN streak + 1 ELSE 0 END, opened, skipped,
                CASE WHEN NOT skipped AND failed AND streak = 2 THEN ts ELSE opened END, ts
         FROM (SELECT n.event_id, n.user_id, n.i, n.failed, n.ts, w.opened, CASE WHEN w.streak = 3 THEN 0 ELSE w.streak END AS streak, coalesce(n.ts < w.opened + INTERVAL 6000 MINUTE, false) AS skipped
               FROM walk w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1))
       SELECT event_id, user_id, CAST(streak AS BIGINT) AS consecutive_failures, opened_at, skipped FROM walk""",
)
def domain_breaker(spark, folder):
    # the test events are far apart, so the pause and the slices are long
    return activity.breaker(_events(spark, folder), "user_id", is_error(), minutes=6000, hours=24 * 7).select(
        "event_id", "user_id", "consecutive_failures", "opened_at", "skipped"
    )


@query(
    "h11_state_changes",
    """SELECT event_id, user_id, old_state, event_type AS new_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_state FROM events)
       WHERE event_type IS DISTINCT FROM old_state""",
)
def state_changes(spark, folder):
    return activity.state_changes(_events(spark, folder), "user_id", "event_type").select(
        "event_id", "user_id", "old_state", F.col("event_type").alias("new_state")
    )


@query(
    "h11_latest_state",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id) AS event_id FROM events GROUP BY 1",
)
def latest_state(spark, folder):
    return activity.latest_state(_events(spark, folder), "user_id").select(
        "user_id", F.col("event_type").alias("state"), "event_id"
    )


@query(
    "h12_active_stage",
    """SELECT user_id, nullif(arg_max(CASE WHEN event_type IN ('signup', 'view') THEN event_type ELSE '' END, (ts, event_id)), '') AS active_stage
       FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error') GROUP BY 1""",
)
def active_stage(spark, folder):
    started = F.col("event_type").isin("signup", "view")
    ended = F.col("event_type").isin("purchase", "error")
    return activity.active_stage(_events(spark, folder), "user_id", started, ended, "event_type")


@query(
    "g1_run_metrics",
    """SELECT user_id AS pipeline_id, count(*) AS attempted, count(*) FILTER (WHERE event_type <> 'error') AS scraped,
         count(*) FILTER (WHERE event_type = 'purchase') AS extracted, count(*) FILTER (WHERE event_type = 'error') AS flagged FROM events GROUP BY 1""",
)
def run_metrics(spark, folder):
    return _events(spark, folder).groupBy(F.col("user_id").alias("pipeline_id")).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(~is_error()).alias("scraped"),
        F.count_if(F.col("event_type") == "purchase").alias("extracted"), F.count_if(is_error()).alias("flagged"),
    )


@query(
    "g20_stage_progress",
    """SELECT user_id, started_at, completed_at, has_failed, round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6::DOUBLE, 3) AS duration_seconds FROM (
         SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS started_at, max(ts) FILTER (WHERE event_type = 'purchase') AS completed_at,
           bool_or(event_type = 'error') AS has_failed FROM events GROUP BY 1)""",
)
def stage_progress(spark, folder):
    kind = F.col("event_type")
    return activity.stage_progress(_events(spark, folder), ["user_id"], kind == "signup", kind == "purchase", is_error())


RATES = {"signup": 0.5, "click": 1.25, "view": 0.1, "purchase": 3.0, "error": 0.0}


@query(
    "g21_stage_costs",
    """WITH c AS (SELECT event_type AS stage, CAST(sum(CAST(ceil(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1),
       p AS (SELECT stage, tokens, CAST(round(tokens * rate / 1e6::DOUBLE, 6) AS DECIMAL(20,6)) AS cost FROM c
         JOIN (VALUES ('signup', 0.5::DOUBLE), ('click', 1.25), ('view', 0.1), ('purchase', 3.0), ('error', 0.0)) r(stage, rate) USING (stage))
       SELECT stage, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost FROM p GROUP BY ROLLUP (stage)""",
)
def stage_costs(spark, folder):
    usage = _events(spark, folder).select(F.col("event_type").alias("stage"), F.ceil("value").cast("bigint").alias("tokens"))
    return matrix.stage_costs(usage, RATES)


@query(
    "c12_insight_classes",
    """SELECT event_id, CASE WHEN contains(event_type, 'purchase') OR contains(event_type, 'click') THEN 'amber' WHEN contains(event_type, 'view') THEN 'green' ELSE 'purple' END AS badge,
         CASE WHEN contains(event_type, 'purchase') OR contains(event_type, 'view') THEN 'PRICING' ELSE 'TECH' END AS insight_group,
         CASE WHEN value > 20 THEN 'High' ELSE 'Medium' END AS impact FROM events""",
)
def insight_classes(spark, folder):
    rows = matrix.classify_insights(
        _events(spark, folder), F.col("event_type"), F.col("value"), high=20,
        pricing=("purchase", "view"), amber=("purchase", "click"), green=("view",),
    )
    return rows.select("event_id", "badge", "insight_group", "impact")


# --------------------------------------------------------------- sort, limit
@query("i1_recent_audits", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_audits(spark, folder):
    rows = _events(spark, folder).filter("event_type = 'error'")
    return activity.newest_rows(rows, ["ts", "event_id"], 50).select("event_id", "user_id")


@query(
    "i2_recent_insights",
    "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def recent_insights(spark, folder):
    rows = activity.newest_rows(_events(spark, folder).filter("event_type = 'click'"), ["ts", "event_id"], 50)
    return tables.nested_json(rows, "props", "k bigint").select("event_id", F.col("props.k").alias("k"))


@query(
    "i3_recent_reports",
    "SELECT o_orderkey, o_orderpriority, o_orderstatus = 'F' AS has_pdf FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
)
def recent_reports(spark, folder):
    rows = activity.newest_rows(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"], 20)
    return rows.select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("has_pdf"))


@query("i4_point_lookup", "SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, folder):
    return table(spark, folder, "orders").filter("o_orderkey = 77").limit(1).drop("o_orderdate")


@query("i7_task_list", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def task_list(spark, folder):
    rows = _events(spark, folder).filter("event_type = 'view'")
    return activity.newest_rows(rows, ["ts", "event_id"], 50).select("event_id", "user_id", "event_type")


@query("i8_recent_events", "SELECT event_id FROM events WHERE event_type <> 'signup' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, folder):
    rows = _events(spark, folder).filter("event_type <> 'signup'")
    return activity.newest_rows(rows, ["ts", "event_id"], 100).select("event_id")


@query(
    "f9_latest_report_records",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey = (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))",
)
def latest_report_records(spark, folder):
    items = table(spark, folder, "lineitem")
    held = table(spark, folder, "orders").join(items.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    last = held.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))).scalar()
    return items.filter(F.col("l_orderkey") == last).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "k10_time_formats",
    """SELECT event_id, strftime(ts, '%Y%m%d') AS compact, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""",
)
def time_formats(spark, folder):
    return _events(spark, folder).select(
        "event_id", F.date_format("ts", "yyyyMMdd").alias("compact"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


# ------------------------------------------------------------------ vectors
@query(
    "a8_vector_load",
    "SELECT vec_id, CAST(label AS VARCHAR) AS company, CAST(len(embedding) AS BIGINT) AS dims, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings",
)
def vector_load(spark, folder):
    return tables.vectors(spark, folder).select(
        "vec_id", "company", F.size("embedding").cast("bigint").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value")
    )


DIM = 64
PLANTED_SQL = """
planted AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS company, embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000, CAST(label AS VARCHAR), CASE WHEN vec_id % 2 = 0 THEN embedding
    ELSE list_transform(embedding, lambda x, i: CASE WHEN i = 1 THEN x + 0.01::FLOAT ELSE x END) END FROM embeddings
  UNION ALL SELECT vec_id + 2000000, CAST(label AS VARCHAR), list_transform(embedding, lambda x, i: CASE WHEN i <= 8 THEN -x ELSE x END) FROM embeddings)
"""


def _planted(spark, folder):
    rows = tables.vectors(spark, folder)
    e = F.col("embedding")
    nudged = F.transform(e, lambda x, i: F.when(i == 0, x + F.lit(0.01).cast("float")).otherwise(x))
    flipped = F.transform(e, lambda x, i: F.when(i < 8, -x).otherwise(x))
    near = rows.select(
        (F.col("vec_id") + 1000000).alias("vec_id"), "company", F.when(F.col("vec_id") % 2 == 0, e).otherwise(nudged).alias("embedding")
    )
    far = rows.select((F.col("vec_id") + 2000000).alias("vec_id"), "company", flipped.alias("embedding"))
    return rows.unionByName(near).unionByName(far)


@query(
    "f11_near_duplicates",
    f"""WITH {PLANTED_SQL} SELECT vec_id, company, EXISTS (SELECT 1 FROM planted b WHERE b.company = a.company AND b.vec_id < a.vec_id
        AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.995) AS is_duplicate FROM planted a""",
)
def near_duplicates(spark, folder):
    return vec.near_duplicates(_planted(spark, folder), DIM).select("vec_id", "company", "is_duplicate")


@query(
    "i6_nearest_to_centroid",
    """WITH c AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
       q AS (SELECT label, list(x ORDER BY i) AS q FROM c GROUP BY 1),
       s AS (SELECT CAST(e.label AS VARCHAR) AS company, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS similarity FROM embeddings e JOIN q USING (label))
       SELECT company, vec_id, similarity, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5""",
)
def nearest_to_centroid(spark, folder):
    rows = tables.vectors(spark, folder)
    found = vec.nearest(rows, vec.company_centroids(rows))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "i6_nearest_in_store",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity
         FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
       SELECT query_id, vec_id, similarity, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5""",
)
def nearest_in_store(spark, folder):
    rows = tables.vectors(spark, folder)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest.nearest(rows, asked).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "k6_unit_vectors",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length,
         round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_unit FROM embeddings""",
)
def unit_vectors(spark, folder):
    e = F.col("embedding")
    return tables.vectors(spark, folder).select(
        "vec_id", F.round(V.norm(e), 6).alias("length"), F.round(V.unit(e)[0], 6).alias("first_unit")
    )


@query(
    "k5_text_equality",
    "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS unchanged FROM documents",
)
def text_equality(spark, folder):
    # seeded hash vectors are equal just when the texts are
    rows = table(spark, folder, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return deltas.repeated(rows, ["content_hash"], "doc_id").drop("content_hash")


VOWELS = "aeiou"


def vowel_model():
    """A stand-in embedding that SQL can check: how often each vowel comes, counted for a whole batch at once."""

    def embed(texts: pd.Series) -> list:
        counts = np.stack([texts.str.count(v).to_numpy(np.float64) for v in VOWELS], axis=1)
        return list(counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True)))

    return embed


@query(
    "m2_embed",
    "SELECT doc_id, "
    + ", ".join(f"round((length(text) - length(replace(text, '{v}', ''))) / greatest(1, length(regexp_replace(text, '[^{VOWELS}]', '', 'g'))), 6) AS {v}_share" for v in VOWELS)
    + " FROM documents",
)
def embed(spark, folder):
    rows = vec.embed(table(spark, folder, "documents").select("doc_id", "text"), "text", vowel_model)
    shares = [F.round(F.col("embedding")[i].cast("double"), 6).alias(f"{v}_share") for i, v in enumerate(VOWELS)]
    return rows.select("doc_id", *shares)


@query("m2_hashed_texts", "SELECT doc_id, CAST(384 AS BIGINT) AS dims, 1.0::DOUBLE AS length FROM documents")
def hashed_texts(spark, folder):
    rows = vec.embed(table(spark, folder, "documents").select("doc_id", "text"), "text", vec.hashed_texts)
    return rows.select("doc_id", F.size("embedding").cast("bigint").alias("dims"), F.round(V.norm(F.col("embedding")), 4).alias("length"))


@query("b9_vector_store", "SELECT vec_id, CAST(label AS VARCHAR) AS company, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
def vector_store(spark, folder):
    path = scratch_path(spark, "vectors")
    sinks.vectors(tables.vectors(spark, folder), path)
    return spark.read.parquet(path).select("vec_id", "company", F.size("embedding").cast("bigint").alias("dims"))


# items as they are, and cut to two, one and three words
@query(
    "f13_snippet_join",
    """WITH w AS (SELECT item_id, text, string_split_regex(trim(text), '\\s+') AS w FROM benchmark),
       n AS (SELECT item_id * 10 + k AS item_id, CASE k WHEN 0 THEN text WHEN 1 THEN array_to_string(w[1:2], ' ') WHEN 2 THEN w[1] ELSE array_to_string(w[1:3], ' ') END AS text
             FROM w, (VALUES (0), (1), (2), (3)) v(k)),
       s AS (SELECT item_id, lower(CASE WHEN len(string_split_regex(trim(text), '\\s+')) >= 3 THEN array_to_string(string_split_regex(trim(text), '\\s+')[1:4], ' ') ELSE text END) AS snippet FROM n)
       SELECT DISTINCT item_id, doc_id FROM s JOIN documents d ON contains(lower(d.text), snippet) WHERE snippet <> ''""",
)
def snippet_join(spark, folder):
    items = table(spark, folder, "benchmark")
    words = F.split(T.strip_edges(F.col("text")), r"(?U)\s+")
    cuts = F.array(F.col("text"), *[F.array_join(F.slice(words, 1, n), " ") for n in (2, 1, 3)])
    cited = items.select("item_id", F.posexplode(cuts).alias("cut", "text")).withColumn("item_id", F.col("item_id") * 10 + F.col("cut"))
    return grounding.snippet_in_documents(cited, table(spark, folder, "documents").select("doc_id", "text"))


# ------------------------------------------------------------------ samples
def _samples(spark, folder):
    pages = admission.admit(tables.pages(spark, folder))
    return pages.select(
        F.col("page_id").alias("sample_id"), F.col("html").alias("dom"), F.col("host").alias("company_name"),
        F.col("url").alias("source_url"), (F.col("verdict") == admission.APPROVED).alias("admitted"),
    )


def _all_samples(spark, folder):
    rows = _samples(spark, folder)
    refused = rows.filter("NOT admitted").drop("company_name")
    return training.all_samples(rows.filter("admitted"), refused).drop("admitted")


@query(
    "j4_all_samples",
    f"""SELECT page_id AS sample_id, CASE WHEN lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) = 'https' THEN {B.HOST_SQL} END AS company_name,
        CAST(length(html) AS BIGINT) AS chars FROM pages WHERE html <> ''""",
)
def all_samples(spark, folder):
    return _all_samples(spark, folder).select("sample_id", "company_name", F.length("dom").cast("bigint").alias("chars"))


CHAT_SQL = f"""
SELECT page_id AS sample_id, CAST(3 AS BIGINT) AS messages, md5('{training.USER_HEAD}' || chr(10) || chr(10) || '```html' || chr(10) || regexp_replace(html, '^\\s+|\\s+$', '', 'g') || chr(10) || '```') AS user_hash,
  CASE WHEN lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) = 'https' THEN {B.HOST_SQL} ELSE 'Unknown' END AS company_name FROM pages WHERE html <> ''
"""


def _chat_view(samples):
    target = F.try_parse_json(F.col("messages")[2]["content"])
    return samples.select(
        "sample_id", F.size("messages").cast("bigint").alias("messages"), F.md5(F.col("messages")[1]["content"]).alias("user_hash"),
        F.try_variant_get(target, "$.company_name", "string").alias("company_name"),
    )


@query("g16_chat_samples", CHAT_SQL)
def chat_samples(spark, folder):
    return _chat_view(training.chat_samples(_all_samples(spark, folder)))


@query("b5_jsonl_export", CHAT_SQL)
def jsonl_export(spark, folder):
    rows = training.chat_samples(_all_samples(spark, folder))
    path = scratch_path(spark, "samples")
    sinks.json_lines(rows, path)
    return _chat_view(spark.read.schema(rows.schema).json(path))


@query(
    "g17_instruction_samples",
    f"""SELECT page_id AS sample_id, md5(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) AS input_hash, url AS source_url FROM pages WHERE html <> ''""",
)
def instruction_samples(spark, folder):
    rows = training.instruction_samples(_all_samples(spark, folder))
    target = F.try_parse_json("output")
    return rows.select(
        "sample_id", F.md5("input").alias("input_hash"), F.try_variant_get(target, "$.source_url", "string").alias("source_url")
    )


@query(
    "g18_conversation_messages",
    """SELECT conv_id, CAST(turn // 1000 AS BIGINT) AS part, count(*) AS messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_hash
       FROM conversations GROUP BY 1, 2""",
)
def conversation_messages(spark, folder):
    rows = training.conversations(table(spark, folder, "conversations"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return rows.select("conv_id", "part", F.size("messages").cast("bigint").alias("messages"), F.md5(flat).alias("text_hash"))


# --------------------------------------------------------- model extraction
def page_model():
    """A stand-in model: answers with the page address, and badly at first for some pages."""

    def answer(prompts: pd.Series, attempt: int) -> pd.Series:
        def one(prompt: str) -> str:
            size = len(prompt)
            if attempt == 0 and "/es/" in prompt:
                return "I cannot say {"
            if attempt == 0 and "/fr/" in prompt:
                return '{"company": ""}'  # an object, but not a sound one
            if "/de/" in prompt:
                return "no data"
            if attempt:
                mended = {"critique": "no object", "root_cause": "words", "remedy": "braces", "corrected_output": {"company": "mended"}}
                return "I see.\n" + json.dumps(mended)
            return "```json\n" + json.dumps({"company": "found", "attempt": attempt, "some": size > 0}) + "\n```"

        return prompts.map(one)

    return answer


@query(
    "e12_extract_with_repair",
    """SELECT page_id, CAST(again AS BIGINT) AS attempt, CASE WHEN again THEN 'mended' ELSE 'found' END AS company,
              CASE WHEN again THEN 'words' END AS root_cause FROM (SELECT page_id, regexp_matches(url, '/(es|de|fr)/') AS again FROM pages)""",
)
def extract_with_repair(spark, folder):
    pages = B.cleaned_pages(spark, folder).select("page_id", "url", "text")
    def named(answer, text):
        return F.when(F.coalesce(F.length(answer["company"]), F.lit(0)) == 0, "company_name_missing")

    return extraction.extract(pages, page_model, "page_id", answer="company string, attempt int, some boolean", check=named).select(
        "page_id", "attempt", F.get_json_object("payload", "$.company").alias("company"), "root_cause"
    )


def length_model():
    return lambda prompts, attempt: prompts.str.len().map(lambda n: json.dumps({"chars": int(n)}))


@query(
    "m1_model_function",
    f"""WITH {B.CLEANED_SQL} SELECT page_id, CAST(length(text) AS BIGINT) AS chars FROM scrubbed""",
)
def model_function(spark, folder):
    prompts = B.cleaned_pages(spark, folder).select("page_id", F.col("text").alias("prompt"))
    answered = extraction.call_model(prompts, length_model, 0)
    return answered.select("page_id", F.try_variant_get(T.parsed_json(F.col("response")), "$.chars", "bigint").alias("chars"))


# -------------------------------------------------------------------- sinks
@query(
    "b1_append_tables",
    f"""WITH {B.CLEANED_SQL}, {B.OFFERS_SQL} SELECT 'raw_documents' AS name, url AS key, sha256(text) || ' ' || length(text) || ' true' AS facts FROM scrubbed
        UNION ALL SELECT 'compliance_audits', url, 'CHECKED' FROM pages
        UNION ALL SELECT 'extracted_records', company_name || ' ' || run, count(*) || ' 0.9' FROM offers GROUP BY company_name, run
        UNION ALL SELECT 'insights', 'New ' || n_name, '2 ["a","b"]' FROM nation UNION ALL SELECT 'reports', r_name, 'rpt ["x"]' FROM region
        UNION ALL SELECT 'runs', 'run-1', 'COMPLETED ' || (SELECT count(*) FROM pages)
        UNION ALL SELECT 'runs', 'run-2', 'FAILED'""",
)
def append_tables(spark, folder):
    cleaned = B.cleaned_pages(spark, folder)
    docs = cleaned.select(
        "url", F.col("host").alias("domain"), F.col("text").alias("content_markdown"),
        T.content_hash(F.col("text")).alias("content_hash"), F.length("text").alias("content_length"), F.lit(True).alias("pii_redacted"),
    )
    path = scratch_path(spark, "tables")
    records = B.records(B.offers(spark, folder))
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    two = F.array(F.lit("a"), F.lit("b"))
    counted = cleaned.agg(F.count(F.lit(1)).cast("int").alias("sources_count"), F.lit("COMPLETED").alias("status"))
    for run, name, rows in (
        ("run-1", "raw_documents", docs),
        ("run-1", "compliance_audits", cleaned.select(F.col("url").alias("source_url"), F.lit("CHECKED").alias("compliance_status"))),
        ("run-1", "extracted_records", records.filter("run = 'R1'")),
        ("run-2", "extracted_records", records.filter("run = 'R2'")),
        ("run-1", "insights", nations.select(F.concat(F.lit("New "), "n_name").alias("title"), two.alias("corroborating_sources"), F.lit(2).alias("corroboration_count"))),
        ("run-1", "reports", regions.select(F.lit("rpt").alias("report_id"), F.col("r_name").alias("title"), F.array(F.lit("x")).alias("citations"))),
        ("run-1", "runs", counted),
        ("run-2", "runs", spark.range(1).select(F.lit("FAILED").alias("status"))),
    ):
        sinks.append_to(rows, path, name, run)

    def read(name, key, *facts):
        rows = sinks.read_table(spark, path, name)
        return rows.select(F.lit(name).alias("name"), key.alias("key"), F.concat_ws(" ", *facts).alias("facts"))

    c = F.col
    run_of = F.when(c("pipeline_id") == "run-1", "R1").otherwise("R2")
    parts = [
        read("raw_documents", c("url"), c("content_hash"), c("content_length").cast("string"), c("pii_redacted").cast("string")),
        read("compliance_audits", c("source_url"), c("compliance_status")),
        read("extracted_records", F.concat_ws(" ", "company_name", run_of), F.size("pricing_tiers").cast("string"), c("extraction_confidence").cast("string")),
        read("insights", c("title"), c("corroboration_count").cast("string"), F.to_json("corroborating_sources")),
        read("reports", c("title"), c("report_id"), F.to_json("citations")),
        read("runs", c("pipeline_id"), c("status"), c("sources_count").cast("string")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "b2_current_run_status",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS event_id FROM events GROUP BY 1",
)
def current_run_status(spark, folder):
    return sinks.current_rows(_events(spark, folder), ["user_id"], ["ts", "event_id"]).select(
        "user_id", F.col("event_type").alias("status"), "event_id"
    )


@query("b3_duplicate_keys", "SELECT o_custkey, o_orderpriority, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return sinks.duplicate_keys(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"])


@query("b3_unique_rows", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def unique_rows(spark, folder):
    return sinks.unique_rows(table(spark, folder, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


# ------------------------------------------------------------------ streams
def _ntz(df, *columns):
    for name in columns:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


@query("l1_event_ingest", "SELECT event_id, user_id, event_type, ts FROM events")
def event_ingest(spark, folder):
    rows = streams.appended(streams.event_stream(spark, folder).select("event_id", "user_id", "event_type", "ts"), "ingest")
    return _ntz(rows, "ts")


@query(
    "l2_tumbling_counts",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, event_type, count(*) AS events
       FROM events GROUP BY 1, 2, 3""",
)
def tumbling_counts(spark, folder):
    counts = streams.tumbling_counts(streams.event_stream(spark, folder), "event_type")
    return _ntz(streams.newest(counts, ["window_start", "event_type"], "tumbling"), "window_start", "window_end")


@query(
    "l3_sliding_error_rate",
    """WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start, event_type FROM events, (VALUES (0), (1), (2), (3)) v(k))
       SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
         round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM s GROUP BY 1, 2""",
)
def sliding_error_rate(spark, folder):
    rate = streams.sliding_error_rate(streams.event_stream(spark, folder), is_error())
    return _ntz(streams.newest(rate, ["window_start"], "sliding"), "window_start", "window_end")


@query(
    "l4_sessions",
    """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS opens FROM events),
       g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
       s AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS events FROM g GROUP BY user_id, n)
       SELECT *, window_end > (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) AS open FROM s""",
)
def sessions(spark, folder):
    return _ntz(streams.all_sessions(streams.event_stream(spark, folder), "user_id"), "window_start", "window_end")


def disordered(spark, folder: str, name: str, columns: list[str], batches: int = 4):
    """A table as a stream of several micro-batches, dealt by a hash, so that most rows come late.

    A micro-batch has about a share of the files, which are as many as the tasks that read the table.
    """
    rows = table(spark, folder, name).select(*columns)
    path = scratch_path(spark, f"{name}-arrivals")
    each = -(-rows.rdd.getNumPartitions() // batches)
    rows.repartition(batches * each, F.xxhash64(*columns)).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in columns else stream


@query("l5_rolling_buffer", f"SELECT user_id, event_id FROM ({LAST_SQL}) WHERE age <= 20")
def rolling_buffer(spark, folder):
    events = disordered(spark, folder, "events", ["event_id", "ts", "user_id"])
    return streams.rolling_buffer(events, "user_id", 20).select("user_id", "event_id")


def arrivals(spark, folder: str, name: str, columns: list[str], time: str, key: str, batches: int = 2):
    """A table that comes in halves of its time, one row in ten a half late: (stream, lateness) after each arrival."""
    rows = table(spark, folder, name).select(*columns)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    first, last = rows.agg(F.min(us), F.max(us)).first()
    width = (last - first) // batches + 1
    late = (F.pmod(F.xxhash64(key), F.lit(10)) == 0).cast("int")
    part = F.floor((us - F.lit(first)) / F.lit(width)).cast("int") + late
    path = scratch_path(spark, f"{name}-arrivals")
    for i in range(batches + 1):  # late rows of the last part come by themselves
        rows.filter(part == i).write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path), f"{2 * width // 60_000_000 + 1} minutes"


@query("l6_streaming_health", f"WITH {STREAK_SQL} SELECT event_id, user_id, consecutive_failures, consecutive_failures < 3 AS healthy FROM health")
def streaming_health(spark, folder):
    path = scratch_path(spark, "health")
    for events, lateness in arrivals(spark, folder, "events", ["event_id", "ts", "user_id", "event_type"], "ts", "event_id"):
        now = streams.health(events, "user_id", is_error(), path=path, lateness=lateness)
    return now.select("event_id", "user_id", "consecutive_failures", "healthy")


@query("l7_first_seen_content", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_seen_content(spark, folder):
    return streams.first_seen(disordered(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text")


@query(
    "l7_new_content",
    """SELECT content_hash, CAST(min(doc_id * 4 // ((SELECT max(doc_id) FROM documents) + 1)) AS INT) AS arrival
       FROM (SELECT sha256(text) AS content_hash, doc_id FROM documents) GROUP BY 1""",
)
def new_content(spark, folder):
    docs = table(spark, folder, "documents")
    arrival = F.expr(f"CAST(doc_id * 4 DIV {docs.agg(F.max('doc_id')).first()[0] + 1} AS INT)").alias("arrival")
    arrived, path = scratch_path(spark, "documents-arrivals"), scratch_path(spark, "content")
    rows = docs.select("doc_id", "text", arrival)
    for i in range(4):
        rows.filter(F.col("arrival") == i).write.mode("append").parquet(arrived)
        streams.new_content(spark.readStream.schema(rows.schema).parquet(arrived), "text", path, ["arrival"])
    return spark.read.parquet(f"{path}/data").select("content_hash", "arrival")


@query(
    "l8_price_changes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, previous_price, CASE WHEN previous_price IS NULL THEN NULL
         WHEN abs((l_extendedprice - previous_price) / previous_price * 100) >= 30 THEN 'CRITICAL' WHEN abs((l_extendedprice - previous_price) / previous_price * 100) >= 15 THEN 'HIGH'
         WHEN abs((l_extendedprice - previous_price) / previous_price * 100) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
       FROM (SELECT *, lag(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS previous_price FROM lineitem)""",
)
def price_changes(spark, folder):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    path = scratch_path(spark, "prices")
    for items, lateness in arrivals(spark, folder, "lineitem", ["l_partkey", *order], "l_shipdate", "l_orderkey"):
        now = streams.price_changes(items, ["l_partkey"], "l_extendedprice", order, path, lateness)
    return now.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "previous_price", "severity")


@query("l9_incremental_trigger", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def incremental_trigger(spark, folder):
    # the second trigger finds nothing new, as its checkpoint knows the files
    path = scratch_path(spark, "daily")
    for _ in range(2):
        streams.append_files(streams.event_stream(spark, folder).select("event_id", "event_type"), path)
    done = spark.read.parquet(f"{path}/data")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
