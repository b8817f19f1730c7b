"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veralytics.functions import text
from veralytics.operators import retrieval as X
from veralytics.operators import vector_index
from veralytics.plans.medallion import _silver
from veralytics.plans.registry import query
from veralytics.session import cut_lineage, stored
from veralytics.sources.fixtures import AS_OF, ORACLE_PARTS, Tables

_COS = "list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[]))"
COS = _COS.format(a="q", b="d")
TOK = "regexp_extract_all(lower({x}), '[a-z0-9]+')"

ORACLE_PARTS["ox_ask"] = """
SELECT query_id, query, embedding, CASE WHEN query_id % 2 = 0 THEN domain END AS domain,
  CASE query_id % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'all' ELSE 'bronze' END AS layer FROM {fx_queries}
"""
ORACLE_PARTS["ox_layers"] = """
SELECT * FROM (VALUES ('gold','gold'),('silver','gold'),('silver','silver'),('bronze','bronze'),('all','gold'),('all','silver'),('all','bronze')) AS v(layer, target)
"""
ORACLE_PARTS["ox_targets"] = """
SELECT a.query_id, d.domain, d.layer, d.layer || '_' || d.domain AS collection
FROM {ox_ask} a JOIN {ox_layers} l USING (layer) JOIN (SELECT DISTINCT domain, layer FROM {fx_docs}) d ON d.layer = l.target AND (a.domain IS NULL OR a.domain = d.domain)
"""
ORACLE_PARTS["ox_dense"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.query_id, x.collection, d.doc_id, round(greatest({COS}, 0), 12) AS score
  FROM {{ox_targets}} x JOIN {{ox_ask}} q USING (query_id) JOIN {{fx_docs}} d ON d.layer = x.layer AND d.domain = x.domain
  WHERE d.embedding IS NOT NULL)) WHERE rank <= 6
"""


def asked(t: Tables) -> DataFrame:
    n = F.col("query_id")
    layer = F.when(n % 4 == 0, "gold").when(n % 4 == 1, "silver").when(n % 4 == 2, "all").otherwise("bronze")
    return t["fx_queries"].withColumn("layer", layer).withColumn("domain", F.when(n % 2 == 0, F.col("domain")))


def targets(t: Tables) -> DataFrame:
    return X.layer_resolve(asked(t).select(F.col("query_id").alias("request_id"), "domain", "layer"), t["fx_docs"])


def dense(t: Tables) -> DataFrame:
    queries = asked(t).select("query_id", "embedding").join(targets(t).withColumnRenamed("request_id", "query_id").select("query_id", "collection"), "query_id")
    return X.dense_topk(queries, t["fx_docs"].withColumn("collection", F.concat_ws("_", "layer", "domain")), 6)


_DOC = "'entity: ' || entity || ' | value: ' || value"


@query(
    "doc_build",
    """SELECT 'gold_' || domain || '_' || substring(regexp_replace(lower(entity), '[^a-z0-9_]', '_', 'g'), 1, 64) || '_' || CAST(version AS STRING) AS doc_id,
      domain, 'gold' AS layer, entity, value, CAST(effective_date AS STRING) AS effective_date, CAST(version AS STRING) AS version, coalesce(is_current, 'true') AS is_current,
      'entity: ' || entity || ' | value: ' || value || ' | effective_date: ' || CAST(effective_date AS STRING) || ' | version: ' || CAST(version AS STRING) || coalesce(' | is_current: ' || nullif(is_current, ''), '')
        || CASE WHEN expiry_date <> '' THEN ' | expiry_date: ' || expiry_date ELSE '' END AS text
    FROM {fx_gold}""",
)
def _(t: Tables) -> DataFrame:
    rows = t.gold.select(
        "domain", "entity", "value", "effective_date", "version", "is_current", "expiry_date", F.col("version").alias("row_no")
    )
    return X.doc_build(rows, "gold")


def _index(t: Tables) -> DataFrame:
    gold = t.gold.select("domain", "entity", "value", "effective_date", "version", "is_current", F.col("version").alias("row_no"))
    silver = _silver(t).select("domain", F.col("segment_name").alias("entity"), F.col("min_annual_revenue_usd").alias("value"), F.col("c_custkey").alias("row_no"))
    bronze = t["fx_bronze"].select("domain", F.col("segment_name").alias("entity"), "support_tier", F.col("c_custkey").alias("row_no"))
    return X.index_build(gold, silver, bronze)


_SILVER_ROWS = """SELECT domain FROM {fx_bronze} WHERE lower(is_duplicate) <> 'true' AND lower(has_nulls) <> 'true' AND
  (CASE WHEN trim(segment_name) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(min_annual_revenue) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(support_tier) <> '' THEN 1 ELSE 0 END) >= 2"""
ORACLE_PARTS["ox_collections"] = f"""
SELECT 'gold' AS layer, domain, count(*) AS documents FROM {{ox_current}} GROUP BY domain
UNION ALL SELECT 'gold_history', domain, count(*) FROM {{fx_gold}} GROUP BY domain
UNION ALL SELECT 'silver', domain, count(*) FROM ({_SILVER_ROWS}) GROUP BY domain
UNION ALL SELECT 'bronze', domain, count(*) FROM {{fx_bronze}} GROUP BY domain
"""


@query(
    "index_build",
    f"""SELECT layer, domain, entity, value FROM (
      SELECT 'gold' AS layer, domain, entity, value FROM {{ox_current}} UNION ALL SELECT 'gold_history', domain, entity, value FROM {{fx_gold}}
      UNION ALL SELECT 'silver', domain, segment_name, coalesce(min_annual_revenue, '') FROM {{fx_bronze}} WHERE c_custkey IN (SELECT c_custkey FROM ({_SILVER_ROWS.replace('SELECT domain', 'SELECT c_custkey')}))
      UNION ALL SELECT 'bronze', domain, segment_name, '' FROM {{fx_bronze}})""",
)
def _(t: Tables) -> DataFrame:
    return _index(t).select("layer", "domain", "entity", "value")


@query("collection_stats", "SELECT * FROM {ox_collections}")
def _(t: Tables) -> DataFrame:
    return X.collection_stats(_index(t))


@query(
    "upsert_docs",
    """SELECT doc_id, text FROM (SELECT 'd' || CAST(doc_id AS STRING) AS doc_id, text FROM {documents} WHERE doc_id NOT IN (SELECT page_id FROM {pages})
      UNION ALL SELECT 'd' || CAST(page_id AS STRING), CASE WHEN page_id % 2 = 0 THEN url ELSE html END FROM {pages})""",
)
def _(t: Tables) -> DataFrame:
    old = t["documents"].select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    # Each page comes twice; the url is the later row of even pages, the html that of odd ones.
    again = F.array(F.struct(F.lit(1).alias("at"), F.col("html").alias("text")), F.struct((F.expr("page_id % 2 = 0").cast("int") * 2).alias("at"), F.col("url").alias("text")))
    new = t["pages"].select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("doc_id"), F.inline(again))
    return X.upsert_docs(old, new, "at")


@query("tokenize", f"SELECT doc_id, CAST(len({TOK.format(x='text')}) AS INT) AS tokens, array_to_string({TOK.format(x='text')}, ' ') AS terms FROM {{documents}}")
def _(t: Tables) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return t["documents"].select("doc_id", F.size(tokens).alias("tokens"), F.array_join(tokens, " ").alias("terms"))


@query("layer_resolve", "SELECT query_id AS request_id, domain, layer, collection FROM {ox_targets}")
def _(t: Tables) -> DataFrame:
    return targets(t)


@query("dense_topk", "SELECT query_id, collection, doc_id, round(score, 6) AS score, rank FROM {ox_dense}")
def _(t: Tables) -> DataFrame:
    return dense(t).withColumn("score", F.round("score", 6))


# Small clusters, so that the exact search has clusters to leave out.
def _clusters(t: Tables) -> vector_index.VectorIndex:
    return vector_index.build(t["embeddings"].select(F.col("vec_id").alias("doc_id"), F.lit("all").alias("g"), "embedding"), "g", clusters=32)


@query(
    "vector_index_search",
    f"""SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT q.query_id, d.vec_id AS doc_id, round(greatest({COS}, 0), 12) AS score FROM {{fx_queries}} q, {{embeddings}} d)) WHERE rank <= 10""",
)
def _(t: Tables) -> DataFrame:
    found = vector_index.search(t["fx_queries"].withColumn("g", F.lit("all")), _clusters(t), 10, "g")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# BM25 inside each query's own candidates.
ORACLE_PARTS["ox_cand"] = "SELECT c.query_id, q.query, c.doc_id, c.score AS dense, d.text FROM {ox_dense} c JOIN {ox_ask} q USING (query_id) JOIN {fx_docs} d USING (doc_id)"
ORACLE_PARTS["ox_bm25"] = f"""
WITH k AS (SELECT query_id, doc_id, {TOK.format(x='text')} AS tk FROM {{ox_cand}}),
st AS (SELECT query_id, count(*) AS n, avg(len(tk)) AS m FROM k GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format(x='query')}) AS term FROM {{ox_ask}}) GROUP BY 1, 2),
tf AS (SELECT query_id, doc_id, len, term, count(*) AS tf FROM (SELECT query_id, doc_id, len(tk) AS len, unnest(tk) AS term FROM k) GROUP BY 1, 2, 3, 4),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
raw AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / m))) AS s
  FROM tf JOIN qt USING (query_id, term) JOIN df USING (query_id, term) JOIN st USING (query_id) GROUP BY 1, 2)
SELECT k.query_id, k.doc_id, coalesce(s / max(s) OVER (PARTITION BY k.query_id), 0) AS bm25 FROM k LEFT JOIN raw USING (query_id, doc_id)
"""


@query("bm25_scores", "SELECT query_id, doc_id, round(bm25, 6) AS bm25_score FROM {ox_bm25}")
def _(t: Tables) -> DataFrame:
    pairs = cut_lineage(dense(t).select("query_id", "doc_id"))
    return X.bm25_scores(pairs, t["fx_docs"], asked(t)).withColumn("bm25_score", F.round("bm25_score", 6))


_BM25 = f"""
    WITH k AS (SELECT doc_id, {TOK.format(x='text')} AS tk FROM {{documents}}),
    st AS (SELECT count(*) AS n, avg(len(tk)) AS m FROM k),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK.format(x='text')}) AS term FROM {{benchmark}}) GROUP BY 1, 2),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(tk) AS len, unnest(tk) AS term FROM k) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / m))), 9) AS score
      FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


@query("bm25_search", _BM25)
def _(t: Tables) -> DataFrame:
    return X.bm25_search(_bench(t), t["documents"], 10).withColumn("score", F.round("score", 6))


def _bench(t: Tables) -> DataFrame:
    return t["benchmark"].select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("bm25_index_search", _BM25)
def _(t: Tables) -> DataFrame:
    return X.bm25_index_search(_bench(t), stored(X.bm25_index(t["documents"])), 10).withColumn("score", F.round("score", 6))


@query(
    "hybrid_search",
    """
    SELECT query_id, rank, domain, entity, current_value, round(dense, 4) AS similarity_score, round(bm25, 4) AS bm25_score, round(comb, 4) AS combined_score, doc_id, layer
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY comb DESC, doc_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, domain, entity ORDER BY comb DESC, doc_id) AS pick FROM (
        SELECT c.query_id, d.domain, d.entity, d.value AS current_value, c.dense, b.bm25, d.doc_id, d.layer,
          round((CAST(0.6 AS DOUBLE) * c.dense + CAST(0.4 AS DOUBLE) * b.bm25) * d.boost, 9) AS comb
        FROM {ox_cand} c JOIN {ox_bm25} b USING (query_id, doc_id) JOIN {fx_docs} d USING (doc_id))) WHERE pick = 1) WHERE rank <= 3
    """,
)
def _(t: Tables) -> DataFrame:
    return X.hybrid_search(asked(t), t["fx_docs"], k=3)


@query(
    "boost_entity",
    f"""SELECT doc_id, CASE WHEN hit THEN CAST(1.5 AS DOUBLE) ELSE boost END AS boost, CASE WHEN hit THEN TIMESTAMP '{AS_OF}' END AS boosted_at
    FROM (SELECT doc_id, boost, layer = 'gold' AND (domain, entity) IN (SELECT d.domain, 'e' || CAST(doc_id % 10 AS STRING) || '-' || lang
      FROM {{labels}} JOIN {{documents}} USING (doc_id) JOIN {{fx_domains}} d ON d.domain_id = doc_id % 7 WHERE quality = 1) AS hit FROM {{fx_docs}})""",
)
def _(t: Tables) -> DataFrame:
    good = t["labels"].filter(F.col("quality") == 1).join(t["documents"], "doc_id").join(t.domains, F.col("domain_id") == F.col("doc_id") % 7)
    entity = F.concat(F.lit("e"), (F.col("doc_id") % 10).cast("string"), F.lit("-"), "lang")
    return X.boost_entity(t["fx_docs"], good.select("domain", entity.alias("entity")), AS_OF).select("doc_id", "boost", "boosted_at")


# Assistant turns as stored probes.
ORACLE_PARTS["ox_stored"] = f"""
SELECT conv_id * 1000 + turn AS n, d.domain, 'Conv ' || CAST(conv_id AS STRING) AS entity, TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * CAST(conv_id AS INT) AS probe_ts, text
FROM {{conversations}} JOIN {{fx_domains}} d ON d.domain_id = conv_id % 7 WHERE role = 'assistant'
"""


@query(
    "store_probe_result",
    """SELECT 'probe_' || domain || '_' || replace(lower(entity), ' ', '_') || '_' || CAST(CAST(epoch(probe_ts) AS BIGINT) AS STRING) AS doc_id, domain, entity,
      substring('about ' || text, 1, 500) AS question, 'domain:' || domain || ' entity:' || entity || ' question:about ' || text || ' response:' || text || ' grade:CORRECT level:UNKNOWN' AS text FROM {ox_stored}""",
)
def _(t: Tables) -> DataFrame:
    turns = t["conversations"].filter(F.col("role") == "assistant").join(t.domains, F.col("domain_id") == F.col("conv_id") % 7)
    probes = turns.select(
        "domain", F.concat(F.lit("Conv "), F.col("conv_id").cast("string")).alias("entity"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.col("conv_id").cast("int"))).alias("probe_ts"),
        F.concat(F.lit("about "), "text").alias("question"), F.col("text").alias("raw_response"),
        F.lit("CORRECT").alias("crag_grade"), F.lit("UNKNOWN").alias("staleness_level"), F.lit(None).cast("string").alias("extracted_value"),
    )
    return X.store_probe_result(probes).select("doc_id", "domain", "entity", "question", "text")


@query(
    "find_similar_probes",
    f"""SELECT query_id, doc_id, round(score, 4) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM (
        SELECT q.query_id, d.vec_id AS doc_id, e.ts, round(greatest({COS}, 0), 12) AS score FROM {{fx_queries}} q, {{embeddings}} d LEFT JOIN {{events}} e ON e.event_id = d.vec_id))
    WHERE rn <= 10 AND ts >= TIMESTAMP '2024-01-31 21:00:00' - INTERVAL 30 DAY""",
)
def _(t: Tables) -> DataFrame:
    history = t["embeddings"].join(t["events"], F.col("event_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("ts").alias("probe_ts")
    )
    return X.find_similar_probes(t["fx_queries"], history, AS_OF, days=30).drop("probe_ts")


@query(
    "staleness_trajectory",
    """SELECT r.request_id, h.domain, h.entity, CAST(h.probe_date AS STRING) AS probe_date, h.n, h.sim_num
    FROM (SELECT c_custkey AS request_id, d.domain, 'E' || CAST(c_custkey AS STRING) AS entity FROM {customer} JOIN {fx_domains} d ON d.domain_id = c_custkey % 7) r
    JOIN {fx_history} h ON h.domain = r.domain AND contains(lower(h.entity), lower(r.entity))""",
)
def _(t: Tables) -> DataFrame:
    requests = t["customer"].join(t.domains, F.col("domain_id") == F.col("c_custkey") % 7).select(
        F.col("c_custkey").alias("request_id"), "domain", F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("entity")
    )
    return X.staleness_trajectory(t["fx_history"], requests).withColumn("probe_date", F.col("probe_date").cast("string"))


@query(
    "drift_trend",
    """SELECT domain, entity FROM (SELECT domain, entity, CAST(sim_num AS DOUBLE) / n AS s, lag(CAST(sim_num AS DOUBLE) / n, 1) OVER w AS s1, lag(CAST(sim_num AS DOUBLE) / n, 2) OVER w AS s2,
      row_number() OVER (PARTITION BY domain, entity ORDER BY probe_date DESC) AS last FROM {fx_history} WINDOW w AS (PARTITION BY domain, entity ORDER BY probe_date)) WHERE last = 1 AND s2 > s1 AND s1 > s""",
)
def _(t: Tables) -> DataFrame:
    return X.drift_trend(t["fx_history"], F.col("sim_num") / F.col("n")).select("domain", "entity")
