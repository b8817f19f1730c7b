"""Documents, dense and lexical ranking, probe history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veralytics import config as C
from veralytics import dims
from veralytics.functions import clock, text
from veralytics.operators.contains_join import contains_join
from veralytics.operators.medallion import gold_current
from veralytics.operators import postings
from veralytics.operators.postings import idf, query_terms, term_weight
from veralytics.operators.vector_join import vector_topk
from veralytics.session import cut_lineage, stored

Moment = datetime | str

# --- documents -------------------------------------------------------------------


def doc_build(rows: DataFrame, layer: str, row_no: str = "row_no") -> DataFrame:
    """One document per row: its non-empty cells as ``name: value | ...`` plus metadata.

    ``row_no`` numbers the rows of a domain and is part of the id, as rows of a file are.
    """
    cells = [c for c in rows.columns if c not in ("domain", row_no)]
    filled = [
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cells
    ]

    def first_of(*names: str) -> Column:
        present = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in rows.columns]
        return F.coalesce(*present, F.lit(""))

    entity = first_of("entity")
    doc_id = F.concat_ws("_", F.lit(layer), "domain", text.slug(entity, C.SLUG_CHARS), F.col(row_no).cast("string"))
    current = F.col("is_current").cast("string") if "is_current" in rows.columns else F.lit(None).cast("string")
    version = F.col("version").cast("string") if "version" in rows.columns else F.col(row_no).cast("string")
    return rows.select(
        F.substring(doc_id, 1, C.DOC_ID_CHARS).alias("doc_id"),
        "domain",
        F.lit(layer).alias("layer"),
        entity.alias("entity"),
        first_of("value").alias("value"),
        first_of("effective_date", "validated_at", "ingested_at").alias("effective_date"),
        F.coalesce(version, F.lit("")).alias("version"),
        F.coalesce(current, F.lit("true")).alias("is_current"),
        F.concat_ws(" | ", *filled).alias("text"),
    )


def upsert_docs(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Incoming documents replace existing ones of the same id; among incoming the row last in ``order`` wins.

    ``order`` is a column of ``incoming`` that is not kept; ties go to the largest row.
    """
    row = [c for c in incoming.columns if c not in ("doc_id", order)]
    last = F.max_by(F.struct(*row), F.struct(order, *row)).alias("_n")
    newest = incoming.groupBy("doc_id").agg(last).select("doc_id", "_n.*")
    kept = existing.join(newest.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(newest)


def index_build(gold: DataFrame, silver: DataFrame, bronze: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Documents of all collections: gold current, gold history, silver and bronze."""
    return (
        doc_build(gold_current(gold), "gold", row_no)
        .unionByName(doc_build(gold, "gold_history", row_no))
        .unionByName(doc_build(silver, "silver", row_no))
        .unionByName(doc_build(bronze, "bronze", row_no))
    )


def layer_resolve(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Collections to search per request (request_id, domain or null, layer), as far as they exist.

    Silver also searches gold, ``all`` searches gold, silver and bronze; any other name
    stands for itself. A request without domain searches every domain.
    """
    listed = dims.layer_map(requests.sparkSession).withColumnRenamed("layer", "_asked")
    wanted = requests.join(listed, F.col("layer") == F.col("_asked"), "left").select(
        "request_id", "domain", F.explode(F.coalesce("layers", F.array("layer"))).alias("layer")
    )
    present = existing.select("domain", "layer").distinct()
    one = wanted.filter(F.col("domain").isNotNull()).join(present, ["domain", "layer"])
    every = wanted.filter(F.col("domain").isNull()).drop("domain").join(present, "layer")
    return one.select("request_id", "domain", "layer").unionByName(every.select("request_id", "domain", "layer")).withColumn(
        "collection", F.concat_ws("_", "layer", "domain")
    )


def boost_entity(docs: DataFrame, corrections: DataFrame, as_of: Moment, boost: float = C.BOOST) -> DataFrame:
    """Raise the weight of gold documents whose (domain, entity) was corrected."""
    hit = corrections.select("domain", "entity").distinct().withColumn("_hit", F.col("domain").isNotNull())
    boosted = F.coalesce("_hit", F.lit(False)) & (F.col("layer") == "gold")
    before = F.col("boosted_at") if "boosted_at" in docs.columns else F.lit(None).cast("timestamp_ntz")
    return (
        docs.join(hit, ["domain", "entity"], "left")
        .withColumn("boosted_at", F.when(boosted, clock.moment(as_of)).otherwise(before))
        .withColumn("boost", F.when(boosted, F.lit(boost)).otherwise(F.coalesce("boost", F.lit(1.0))))
        .drop("_hit")
    )


def collection_stats(docs: DataFrame) -> DataFrame:
    """Documents per collection."""
    return docs.groupBy("layer", "domain").agg(F.count("*").alias("documents"))


# --- ranking -----------------------------------------------------------------------


def dense_topk(queries: DataFrame, docs: DataFrame, n: int, by: str = "collection") -> DataFrame:
    """Top n documents per query and collection by cosine similarity."""
    return vector_topk(queries, docs, n, by)


def bm25_scores(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Okapi BM25 (k1 = 1.5, b = 0.75) of each query's candidates, divided by the query's best.

    ``pairs`` (query_id, doc_id) are the candidates, ``docs`` (doc_id, text), ``queries``
    (query_id, query). Collection statistics are those of the query's own candidates. The
    inverse document frequency is the always-positive form.
    """
    terms = stored(query_terms(queries))
    pairs = stored(pairs.select("query_id", "doc_id"))
    # The candidates' texts are read once; pairs of known size let Spark leave the texts where they are.
    wanted = stored(docs.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"))
    lengths = wanted.select("doc_id", F.coalesce(F.size(text.tokenize(F.col("text"))), F.lit(0)).alias("_length"))
    found = postings.postings(wanted).join(terms.select("term").distinct(), "term", "left_semi")
    tf = stored(pairs.join(found, "doc_id").join(terms, ["query_id", "term"]))
    stats = pairs.join(lengths, "doc_id").groupBy("query_id").agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("_df"))
    weight = F.col("qtf") * idf(F.col("_n"), F.col("_df")) * term_weight(F.col("tf"), F.col("length"), F.col("_mean"))
    raw = (
        tf.join(df.join(stats, "query_id"), ["query_id", "term"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum(weight).alias("_raw"))
    )
    best = raw.groupBy("query_id").agg(F.max("_raw").alias("_max"))
    scored = raw.join(best, "query_id").select("query_id", "doc_id", (F.col("_raw") / F.col("_max")).alias("bm25_score"))
    return (
        pairs.select("query_id", "doc_id")
        .join(scored, ["query_id", "doc_id"], "left")
        .withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
    )


def bm25_index(docs: DataFrame) -> DataFrame:
    """The inverted index of a corpus in blocks, to be written once and searched often."""
    return postings.block_index(docs)


def bm25_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Top k documents per query by BM25 over the whole corpus: (query_id, doc_id, score, rank)."""
    return postings.search(queries, docs, k)


def bm25_index_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The same over a stored index of ``bm25_index``."""
    return postings.search_index(queries, index, k)


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 3,
    dense_weight: float = C.DENSE_WEIGHT,
    bm25_weight: float = C.BM25_WEIGHT,
) -> DataFrame:
    """Dense candidates per collection, lexical re-ranking, boost, best per entity, top k per query.

    ``queries`` (query_id, query, embedding, domain or null, layer); ``docs`` (doc_id, domain,
    layer, entity, value, text, embedding, boost).
    """
    targets = layer_resolve(queries.select(F.col("query_id").alias("request_id"), "domain", "layer"), docs)
    asked = queries.select("query_id", "embedding").join(
        targets.select(F.col("request_id").alias("query_id"), "collection"), "query_id"
    )
    stored = docs.withColumn("collection", F.concat_ws("_", "layer", "domain"))
    # A few rows per query and collection, read several times by the re-ranking: computed once.
    dense = cut_lineage(dense_topk(asked, stored, 2 * k).select("query_id", "doc_id", F.col("score").alias("_dense")))
    lexical = bm25_scores(dense.select("query_id", "doc_id"), docs, queries.select("query_id", "query"))
    about = docs.select("doc_id", "domain", "layer", "entity", "value", "boost")
    combined = (F.col("_dense") * dense_weight + F.col("bm25_score") * bm25_weight) * F.coalesce("boost", F.lit(1.0))
    scored = dense.join(lexical, ["query_id", "doc_id"]).join(about, "doc_id").withColumn("_combined", F.round(combined, 9))
    row = F.struct("doc_id", "value", "layer", "_dense", "bm25_score", "_combined")
    best = scored.groupBy("query_id", "domain", "entity").agg(
        F.max_by(row, F.struct(F.col("_combined"), -F.col("doc_id"))).alias("_b")
    )
    flat = best.select("query_id", "domain", "entity", "_b.*")
    order = W.partitionBy("query_id").orderBy(F.desc("_combined"), "doc_id")
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id",
        "rank",
        "domain",
        "entity",
        F.col("value").alias("current_value"),
        F.round("_dense", 4).alias("similarity_score"),
        F.round("bm25_score", 4).alias("bm25_score"),
        F.round("_combined", 4).alias("combined_score"),
        "doc_id",
        "layer",
    )


# --- probe history -----------------------------------------------------------------


def store_probe_result(probes: DataFrame) -> DataFrame:
    """Probe history documents: searchable text plus the metadata to filter by."""
    body = F.concat(
        F.lit("domain:"), "domain", F.lit(" entity:"), "entity", F.lit(" question:"), "question", F.lit(" response:"), "raw_response",
        F.lit(" grade:"), "crag_grade", F.lit(" level:"), "staleness_level",
    )
    second = clock.floor_div(clock.epoch_micros(F.col("probe_ts")), 1_000_000)
    return probes.select(
        F.concat_ws("_", F.lit("probe"), text.slug(F.col("domain"), C.SLUG_CHARS), text.slug(F.col("entity"), C.SLUG_CHARS), second.cast("string")).alias("doc_id"),
        "domain",
        "entity",
        "staleness_level",
        "crag_grade",
        "probe_ts",
        F.substring("question", 1, C.PROBE_QUESTION_CHARS).alias("question"),
        F.coalesce("extracted_value", F.lit("")).alias("extracted_value"),
        body.alias("text"),
    )


def find_similar_probes(queries: DataFrame, history: DataFrame, as_of: Moment, days: int = 90) -> DataFrame:
    """The ten most similar stored probes per query, of which those of the last days are kept.

    The time filter comes after the ten are chosen, so fewer may remain.
    """
    everything = F.lit("probe_history").alias("collection")
    near = dense_topk(queries.select("query_id", "embedding", everything), history.select("doc_id", "embedding", everything), C.SIMILAR_PROBES)
    recent = history.drop("embedding").filter(F.col("probe_ts") >= clock.moment(as_of) - clock.days(days))
    return near.join(recent, "doc_id").select("query_id", *[c for c in recent.columns], F.round("score", 4).alias("similarity"))


def staleness_trajectory(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Dated similarities of the entities whose name contains the requested text, in date order."""
    needles = requests.select("request_id", "domain", F.lower("entity").alias("_needle"))
    names = history.withColumn("_name", F.lower("entity"))
    found = contains_join(needles, names, "domain", "_needle", "_name").drop("_needle", "_name")
    return found.orderBy("request_id", "probe_date", "entity")


def drift_trend(history: DataFrame, similarity: Column) -> DataFrame:
    """Entities whose last three similarities strictly fall.

    Only the last three rows of an entity matter, so they are cut per task before the shuffle.
    """
    newest = W.partitionBy("domain", "entity").orderBy(F.desc("probe_date"))
    last = history.withColumn("_sim", similarity).withColumn("_no", F.row_number().over(newest)).filter(F.col("_no") <= 3)
    points = [F.max(F.when(F.col("_no") == i, F.col("_sim"))).alias(f"sim_{i}") for i in (1, 2, 3)]
    grouped = last.groupBy("domain", "entity").agg(*points)
    return grouped.filter((F.col("sim_3") > F.col("sim_2")) & (F.col("sim_2") > F.col("sim_1")))
