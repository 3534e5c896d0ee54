"""The relational layer: filters, joins, pages, counts, vectors, jobs, caches and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.dialect import Dialect
from folioscope.streaming import jobs

SHARED: dict = {}


def q(name: str, *bases: str):
    def add(build):
        SHARED[name] = (bases, build)
        return build

    return add


def plain(name: str, sql: str) -> None:
    """A query that is the same text in both engines; {table} names a table."""
    import re

    SHARED[name] = ((), lambda d: re.sub(r"[{](\w+)[}]", lambda m: d.t(m[1]), sql))


plain("c1_owner_scope", "SELECT doc_id, source, n_chars FROM {documents} WHERE source = 'src1' AND doc_id <> 1")
plain("c2_in_list_join", "SELECT o.o_orderkey, o.o_custkey FROM {orders} o WHERE o.o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")
plain("c3_not_in_list", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
plain("c4_retention_filter", "SELECT event_id, user_id FROM {events} WHERE props IS NOT NULL AND value < 50")
plain("c5_status_in", "SELECT event_type, count(*) AS n FROM {events} WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
plain("c6_ilike_search", "SELECT c_custkey, c_name FROM {customer} WHERE c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%auto%'")
plain("c8_match_type_sorted", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45")
plain("c12_catalogue_search", "SELECT p_partkey, p_name, p_brand FROM {part} WHERE (lower(p_name) LIKE '%a%' OR lower(p_type) LIKE '%brass%') AND p_size BETWEEN 5 AND 15")
plain("c15_known_items_skipped", "SELECT p.page_id, p.url FROM {pages} p WHERE length(p.html) >= 400 AND NOT EXISTS (SELECT 1 FROM {benchmark} b WHERE b.item_id = p.page_id)")
plain("d12_source_lookup", "SELECT n.n_name, r.r_name, count(c.c_custkey) AS customers FROM {nation} n LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name")
plain("d16_attach_names", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id")
plain("d19_uniqueness_probe", "SELECT doc_id, k = 1 AS first_of_text FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM {documents}) z")
plain("e12_flagged_share", "SELECT d.lang, sum(CASE WHEN l.toxic = 1 THEN d.n_chars ELSE 0 END) AS flagged_chars, sum(d.n_chars) AS chars, count(*) AS n FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang")
plain("e15_mean_std_cv", "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(coalesce(stddev_samp(value), 0) / avg(value), 6) AS cv FROM {events} GROUP BY event_type")
plain("e24_provider_maximum", "SELECT user_id, max(value) AS best FROM {events} GROUP BY user_id")
plain("e26_queue_position", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM {events}")
plain("e28_facets", "SELECT lang AS facet, count(*) AS n FROM {documents} GROUP BY lang UNION ALL SELECT source AS facet, count(*) AS n FROM {documents} GROUP BY source")
plain("e29_job_counters", "SELECT source, count(*) AS total, sum(CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END) AS added, sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) AS skipped FROM {documents} GROUP BY source")
plain("f16_latest_version", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) z WHERE k = 1")
plain("g1_newest_first", "SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
plain("g2_offset_page", "SELECT doc_id, source, n_chars, (SELECT count(*) FROM {documents}) AS total FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
plain("g3_latest_job", "SELECT max(ts) AS ts, count(*) AS n FROM {events} WHERE event_type = 'view'")
plain("g4_top_k_per_group", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM {documents}) z WHERE k <= 5")
plain("g9_intersection", "SELECT doc_id FROM {documents} WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM {labels} WHERE quality = 1")
plain("g11_report_order", "SELECT doc_id, toxic, k FROM (SELECT d.doc_id, l.toxic, row_number() OVER (ORDER BY CASE WHEN l.toxic IS NULL THEN 1 ELSE 0 END, l.toxic DESC, d.doc_id) AS k FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) z WHERE k <= 60")
plain("j5_harvest_plan", "SELECT r.r_name AS source, n.n_name AS target, 50 AS limit_per_source FROM {region} r CROSS JOIN {nation} n WHERE r.r_regionkey = n.n_regionkey")
plain("j8_delete_cascade", "SELECT l.l_orderkey, count(*) AS n FROM {lineitem} l LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P' WHERE o.o_orderkey IS NOT NULL GROUP BY l.l_orderkey")
plain("j9_structure_override", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, 0) AS level FROM {documents} d FULL OUTER JOIN {labels} l ON l.doc_id = d.doc_id")
plain("n9_cache_insert_ignore", "SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type")
plain(
    "n14_circuit_breaker",
    """SELECT event_id, user_id, errors, errors >= 3 AS dead FROM (SELECT event_id, user_id, sum(failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS errors FROM (
    SELECT event_id, user_id, ts, failed, sum(1 - failed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM {events}) x) y) z""",
)
plain("r1_pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM {lineitem} GROUP BY l_returnflag, l_linestatus")


@q("n6_sliding_window_limiter")
def _(d: Dialect):
    return f"""SELECT event_id, user_id, n, n <= 10 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {d.ts('ts')} RANGE BETWEEN CAST(3600 AS DOUBLE) PRECEDING AND CURRENT ROW) AS n FROM {d.t('events')}) z"""


@q("a37_cache_ttl")
def _(d):
    return f"""WITH m AS (SELECT max({d.ts('ts')}) AS now FROM {d.t('events')})
    SELECT event_id, CASE WHEN event_type = 'error' THEN now - {d.ts('ts')} <= 86400 ELSE now - {d.ts('ts')} <= 30 * 86400 END AS fresh FROM {d.t('events')} CROSS JOIN m"""


@q("a38_cache_upsert")
def _(d):
    return f"SELECT url_key, page_id FROM (SELECT {d.sha('url')} AS url_key, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS k FROM {d.t('pages')}) z WHERE k = 1"


@q("i_cosine_neighbours")
def _(d):
    if d.spark:
        dot = "aggregate(zip_with(a.e, b.e, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, v) -> s + v)"
        vec = "transform(embedding, x -> CAST(x AS DOUBLE))"
        norm = "sqrt(aggregate(transform(e, x -> x * x), CAST(0 AS DOUBLE), (s, v) -> s + v))"
    else:
        dot = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))"
        vec = "embedding::DOUBLE[]"
        norm = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"
    return f"""WITH v AS (SELECT vec_id, label, {vec} AS e FROM {d.t('embeddings')}), n AS (SELECT vec_id, label, e, {norm} AS norm FROM v),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, {dot} / (a.norm * b.norm) AS cosine FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS k FROM p)
    SELECT a, b, k, round(cosine, 6) AS cosine FROM r WHERE k <= 3"""


def centroids(d: Dialect) -> str:
    if d.spark:
        flat = f"SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM {d.t('embeddings')} LATERAL VIEW posexplode(embedding) t AS i, x"
    else:
        flat = "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
    return f"WITH f AS ({flat}), m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)"


@q("e33_centroids")
def _(d):
    return centroids(d) + " SELECT m.label, m.i, round(m.x / n.norm, 6) AS x FROM m JOIN n ON n.label = m.label"


@q("i7_centroid_scores")
def _(d):
    return centroids(d) + """, s AS (SELECT f.vec_id, m.label, sum(f.x * m.x) / max(n.norm) AS score FROM f JOIN m ON m.i = f.i JOIN n ON n.label = m.label GROUP BY f.vec_id, m.label),
    r AS (SELECT vec_id, label, score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS k FROM s) SELECT vec_id, label, round(score, 6) AS score FROM r WHERE k = 1"""


def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.drain(jobs.hourly_counts(jobs.event_stream(spark, sf_dir)))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {"hourly_event_stream": hourly_stream}
ORACLE_SQL = {"hourly_event_stream": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"}
