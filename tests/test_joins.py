"""The scalable joins against brute force on small random data."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veralytics.operators import contains_join as contains_join_module
from veralytics.operators import coverage, medallion, postings, vector_index, vector_join
from veralytics.operators import injection as I
from veralytics.operators import ordered_join as ordered_join_module
from veralytics.operators import retrieval as X
from veralytics.operators import value as V
from veralytics.operators.contains_join import contains_join
from veralytics.operators.median import exact_median
from veralytics.operators.rootcause import run_gap, schema_drift, silent_drop
from veralytics.operators.spread import spread_join
from veralytics.session import stored

START = dt.datetime(2024, 1, 1)


def test_contains_join(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(80)]
    names = [(i, rng.choice("xy"), w) for i, w in enumerate(words)]
    needles = [(i, rng.choice("xy"), "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))) for i in range(60)]
    got = contains_join(
        spark.createDataFrame(needles, "n int, k string, needle string"), spark.createDataFrame(names, "m int, k string, name string"), "k", "needle", "name"
    )
    expected = sorted((n, m) for n, k, needle in needles for m, k2, name in names if k == k2 and needle in name)
    assert sorted((r.n, r.m) for r in got.collect()) == expected


def test_contains_join_in_blocks(spark, monkeypatch):
    """Many blocks of needles, letters of all kinds, repeated and null rows, and one domain with most of the names."""
    monkeypatch.setattr(contains_join_module, "BLOCK_CHARS", 20)
    monkeypatch.setattr(contains_join_module, "HITS", 3)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abé日🦙 %") for _ in range(rng.randint(0, n)))
    names = [(i, "x" if i % 4 else "y", text(12)) for i in range(400)] + [(900, None, "a"), (901, "x", None), (902, "lone", "a")]
    needles = [(i, "xyz"[i % 3], text(4)) for i in range(90)] + [(95, "x", None), (96, None, "a"), (97, "x", "b"), (98, "x", "b")]
    n, m = spark.createDataFrame(needles, "n int, k string, needle string"), spark.createDataFrame(names, "m int, k string, name string")
    got = contains_join(n, m, "k", "needle", "name")
    assert sorted((r.n, r.m) for r in got.collect()) == sorted((a, b) for a, k, x in needles for b, k2, y in names if x is not None and y is not None and k is not None and k == k2 and x in y)
    assert contains_join(n.limit(0), m, "k", "needle", "name").count() == 0 and contains_join(n, m.limit(0), "k", "needle", "name").count() == 0


def test_lookups_read_gold_once(spark, tmp_path):
    """One scan of the names, whatever the number of requests."""
    gold = [("d", f"Name {i}", str(i), 1 + i % 3, "true") for i in range(50)]
    spark.createDataFrame(gold, "domain string, entity string, value string, version int, is_current string").write.parquet(str(tmp_path / "gold"))
    names = spark.read.parquet(str(tmp_path / "gold"))
    requests = spark.createDataFrame([(1, "d", "name 7"), (2, "d", "E 4"), (3, "d", "none")], "request_id int, domain string, entity string")
    for df, rows in ((medallion.lineage(names, requests), 12), (medallion.entity_lookup(names, requests), 3)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [domain") == 1
        assert df.count() == rows
    found = {r["request_id"]: (r["match_type"], r["gold_entity"]) for r in medallion.entity_lookup(names, requests).collect()}
    assert found == {1: ("exact", "Name 7"), 2: ("contains", "Name 41"), 3: ("none", None)}


def test_lineage_in_order_without_a_sort_of_its_rows(spark, monkeypatch):
    """A blank is in every name; neither it nor repeated, null or equal values cost a shuffle of all pairs or their order."""
    monkeypatch.setattr(ordered_join_module, "ROWS", 16)
    rng = random.Random(5)
    gold = [(rng.choice(["x", "y", None]), rng.choice([None, "Ab c", "b C", "é a", "ZZ "]), rng.choice([None, 1, 2]), str(i % 50)) for i in range(300)]
    asks = [(rng.choice([None, 1, 2, i, i]), rng.choice(["x", "y", "z", None]), rng.choice([" ", " ", "", "B", "É A", "no", None])) for i in range(120)]
    names = spark.createDataFrame(gold, "domain string, entity string, version int, value string")
    requests = spark.createDataFrame(asks, "request_id int, domain string, entity string")
    got = medallion.lineage(names, requests, order=("request_id", "version", "entity"))
    rows = [(r.request_id, r.version, r.entity, r.domain, r.request_entity, r.value) for r in got.collect()]
    expected = [
        (n, v, e, d, asked, value) for n, d, asked in asks for d2, e, v, value in gold
        if d is not None and d == d2 and None not in (e, asked) and asked.lower() in e.lower()
    ]
    low_null = lambda x: (x is not None, x if x is not None else 0)
    place = lambda r: (low_null(r[0]), low_null(r[1]), r[2].encode())
    assert Counter(rows) == Counter(expected) and [place(r) for r in rows] == sorted(map(place, expected))
    assert sorted(got.columns) == ["domain", "entity", "request_entity", "request_id", "value", "version"]


def test_lineage_query_moves_no_pair(spark, sf_dir):
    """The rows come out in order, and no range partitioning deals them out for a sort."""
    history = entry.queries()["lineage"](spark, sf_dir)
    assert "rangepartitioning" not in history._jdf.queryExecution().executedPlan().toString()
    rows = [(r.request_id, r.version, r.entity) for r in history.collect()]
    assert rows == sorted(rows) and len(rows) > 0


@pytest.mark.parametrize("size", [1, 2, 501])
def test_exact_median(spark, size):
    rng = random.Random(size)
    rows = [(k, rng.choice([None, rng.randint(0, 9), rng.gauss(0, 1e6)])) for k in "ab" for _ in range(size)]
    rows = [(k, None if v is None else float(v)) for k, v in rows] + [("c", 5.0), ("d", None)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for key in "abc":
        held = [v for k, v in rows if k == key and v is not None]
        assert got.get(key) == (pytest.approx(np.median(held)) if held else None)
    assert "d" not in got


def moments(rng, n, span=86_400 * 2):
    # Many exact hours and repeats, so that window ends are hit exactly.
    return [START + dt.timedelta(seconds=rng.choice([rng.randint(0, span), 3600 * rng.randint(0, span // 3600)]), microseconds=rng.choice([0, 1])) for _ in range(n)]


def test_injection_outcome_link(spark):
    rng = random.Random(2)
    injections = [(rng.choice("ab"), t) for t in moments(rng, 12)]
    outcomes = [(i, rng.choice("abc"), t) for i, t in enumerate(moments(rng, 300))]
    got = V.injection_outcome_link(
        spark.createDataFrame(injections, "domain string, injected_at timestamp_ntz"),
        spark.createDataFrame(outcomes, "outcome_id int, domain string, outcome_ts timestamp_ntz"),
    )
    window = dt.timedelta(hours=4)
    expected = {i for i, d, t in outcomes if any(d == d2 and t2 <= t <= t2 + window for d2, t2 in injections)}
    assert {r.outcome_id for r in got.collect()} == expected and 0 < len(expected) < 300


def test_inject_takes_first_alive_and_never_expired(spark):
    rng = random.Random(3)
    pending = [(rng.choice("ab"), f"e{i}", str(i), "v1", t) for i, t in enumerate(moments(rng, 40))]
    queries = [(i, rng.choice("abc"), t, "q") for i, t in enumerate(moments(rng, 200))]
    got = I.inject(
        spark.createDataFrame(queries, "query_id int, domain string, query_ts timestamp_ntz, query string"),
        spark.createDataFrame(pending, "domain string, entity string, value string, version string, ready_at timestamp_ntz"),
    )
    ttl = dt.timedelta(hours=4)
    found = {r.query_id: r for r in got.collect()}
    assert len(found) == len(queries)
    for i, d, q, _ in queries:
        alive = sorted((t, e) for d2, e, _, _, t in pending if d2 == d and t <= q < t + ttl)
        assert found[i].injected == bool(alive)
        assert found[i].entity == (alive[0][1] if alive else None)


def test_run_gap(spark):
    hour = dt.timedelta(hours=1)
    rows = [("m", START), ("m", START + 24 * hour), ("m", START + 49 * hour), ("m", START + 80 * hour), ("n", START), ("n", START + 24 * hour)]
    got = run_gap(spark.createDataFrame(rows, "dbt_model string, run_timestamp timestamp_ntz")).collect()
    assert [tuple(r) for r in got] == [("m", START + 24 * hour)]


def vectors(spark, n, key, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} bigint, g string, embedding array<double>")


@pytest.mark.parametrize("sent_rows", [2048, 7])
def test_vector_topk_both_ways(spark, monkeypatch, sent_rows):
    monkeypatch.setattr(vector_join, "SENT_ROWS", sent_rows)
    monkeypatch.setattr(vector_join, "DOC_BLOCK", 16)
    monkeypatch.setattr(vector_join.is_bounded, "__defaults__", (sent_rows,))
    q_rows, q = vectors(spark, 20, "query_id", 1)
    d_rows, d = vectors(spark, 90, "doc_id", 2)

    def cosine(a, b):
        return max(0.0, float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))

    got = {(r.query_id, r["rank"]): r.doc_id for r in vector_join.vector_topk(q, d, 3, "g").collect()}
    near = {r.query_id: r.doc_id for r in vector_join.nearest(q, d, "g").collect()}
    for i, g, v in q_rows:
        order = sorted((-round(cosine(v, w), 12), j) for j, h, w in d_rows if h == g)
        assert [got[(i, n)] for n in (1, 2, 3)] == [j for _, j in order[:3]]
        assert near[i] == order[0][1]


def test_vectors_that_are_not_whole_take_no_part(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", []), (4, "a", [1.0, None]), (5, "a", [0.0, 1.0])]
    d = spark.createDataFrame(rows, "doc_id bigint, g string, embedding array<double>")
    q = d.withColumnRenamed("doc_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in vector_join.vector_topk(q, d, 3, "g").collect())
    assert got == [(1, 1, 1), (1, 2, 5), (5, 1, 5), (5, 2, 1)]


def test_vectors_with_odd_components_cost_no_good_hit(spark):
    """A null, NaN, infinite or shorter vector neither appears nor hides another one."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [nan, 1.0]), (3, "a", [inf, 1.0]), (4, "a", [1.0]), (5, "a", [0.6, 0.8]), (6, None, [1.0, 0.0]), (7, "a", [0.0, 0.0])]
    d = spark.createDataFrame(rows, "doc_id bigint, g string, embedding array<double>")
    q = d.withColumnRenamed("doc_id", "query_id")
    expected = [(1, 1, 1), (1, 2, 5), (4, 1, 4), (5, 1, 5), (5, 2, 1), (7, 1, 1), (7, 2, 5)]
    index = vector_index.build(d, "g", clusters=2)
    for found in (vector_join.vector_topk(q, d, 2, "g"), vector_index.search(q, index, 2, "g")):
        assert sorted((r.query_id, r["rank"], r.doc_id) for r in found.collect()) == expected
        assert found.columns[-1] == "rank" and {r.g for r in found.collect()} == {"a"}
    near = {r.query_id: r.doc_id for r in vector_join.nearest(q, d, "g").collect()}
    assert near == {1: 1, 4: 4, 5: 5, 7: 1}


def clustered(spark, n, seed, spread, dim=16, groups=12):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dim))
    rows = [(i, "ab"[i % 5 == 0], (heads[i % groups] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, g string, embedding array<double>")


@pytest.mark.parametrize("spread,part_rows", [(0.1, 16_384), (1.0, 7)])
def test_vector_index(spark, monkeypatch, tmp_path, spread, part_rows):
    """Exact search equals the plain one, also in small parts and after a round trip; clusters are left out where bounds allow."""
    monkeypatch.setattr(vector_index, "PART_ROWS", part_rows)
    _, d = clustered(spark, 400, 5, spread)
    q = d.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    vector_index.build(d, "g", clusters=12).write(str(tmp_path / "index"))
    index = vector_index.VectorIndex.read(spark, str(tmp_path / "index"))
    assert index.rows.count() == 400  # every row is indexed
    rows = lambda df: sorted((r.query_id, r.g, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    exact = rows(vector_index.search(q, index, 4, "g"))
    assert exact == rows(vector_join.vector_topk(q, d, 4, "g"))
    asked = vector_index.Search(q, index, 4, "g")
    if spread < 0.5:
        assert asked.open_probes()[1].count() * 2 < asked.probes.count()
    fast = rows(vector_index.search(q, index, 4, "g", probes=vector_index.probes_for(index, 4)))
    assert len({r[:2] + (r[3],) for r in fast} & {r[:2] + (r[3],) for r in exact}) >= 0.9 * len(exact)


def test_fast_search_recall_on_whole_embeddings(spark):
    """Vectors that point everywhere alike: the hardest case for clusters."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    d = rows.select(F.col("vec_id").alias("doc_id"), F.lit("all").alias("g"), "embedding")
    q = d.where("doc_id % 17 = 0").withColumnRenamed("doc_id", "query_id")
    index = vector_index.build(d, "g", clusters=32)
    pairs = lambda df: {(r.query_id, r.doc_id) for r in df.collect()}
    exact, fast = pairs(vector_index.search(q, index, 10, "g")), pairs(vector_index.search(q, index, 10, "g", vector_index.probes_for(index, 10)))
    assert len(exact & fast) >= 0.9 * len(exact)


def test_upsert_keeps_the_later_row(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "stays")], "doc_id string, text string")
    new = spark.createDataFrame([("1", "zz first", 1), ("1", "aa last", 2), ("3", "new", 1)], "doc_id string, text string, at int")
    assert sorted(map(tuple, X.upsert_docs(old, new, "at").collect())) == [("1", "aa last"), ("2", "stays"), ("3", "new")]


def plain_bm25(docs, queries, k):
    """docs: {doc_id: text}, queries: {query_id: text}; (query_id, rank, doc_id, score)."""
    cut = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in docs.items()}
    mean = sum(map(len, cut.values())) / max(len(cut), 1)
    df = Counter(t for tokens in cut.values() for t in set(tokens))
    out = []
    for q, words in queries.items():
        scores = {}
        for d, tokens in cut.items():
            tf, s = Counter(tokens), 0.0
            for t, qtf in Counter(re.findall("[a-z0-9]+", words.lower())).items():
                if tf[t]:
                    idf = math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5))
                    s += qtf * idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(tokens) / mean))
            if s > 0:
                scores[d] = round(s, 9)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, d, round(s, 6)) for n, (d, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_docs,chunk_terms,cells", [(64, 200_000, 1_000_000), (3, 5, 7)])
def test_bm25_search(spark, monkeypatch, block_docs, chunk_terms, cells):
    """Also with small blocks, several chunks of queries and sums in small pieces."""
    for name, value in (("BLOCK_DOCS", block_docs), ("CHUNK_TERMS", chunk_terms), ("CELLS", cells)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"  # noqa: E731  one word in most texts
    docs = {i: " ".join(word() for _ in range(rng.randint(0, 40))) for i in range(300)} | {900: None, 901: "", 902: "W1 " * 500, 903: "only here"}
    docs[905] = docs[3]  # ties
    queries = {i: " ".join(word() for _ in range(rng.randint(1, 6))) for i in range(25)} | {50: "only", 51: "nowhere", 52: "", 53: "w1 w1 w1"}
    d = spark.createDataFrame([*docs.items(), (None, "w1 w2")], "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, query string")
    expected = plain_bm25(docs, queries, 5)
    index = stored(X.bm25_index(d))
    for found in (X.bm25_search(q, d, 5), X.bm25_index_search(q, index, 5)):
        assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect()) == expected
    assert X.bm25_search(q, d.limit(0), 5).count() == 0 and X.bm25_search(q.limit(0), d, 5).count() == 0


def test_blocks_below_the_threshold_are_skipped():
    asked = postings.Asked(1)
    asked.add(pa.array([1, 1, 2]), pa.array(["a", "b", "b"]), pa.array([2.0, 1.0, 1.0]))
    block = lambda weight: (pa.array(["a"]), np.array([weight]), np.array([1]), np.array([int(weight * 10)]), np.array([weight]))
    assert [asked.meet(*block(w)) for w in (1.0, 0.4, 0.9, 1.2)] == [1, 0, 0, 1]
    assert asked.found().to_pylist() == [{"query_id": 1, "doc_id": 12, "score": 2.4}]


def test_index_bounds_hold_for_any_mean(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = X.bm25_index(docs).where("term <> ''")
    for mean in (3.0, 400.0):
        weight = lambda r: postings.term_weight(r["tf"], r["length"], F.lit(mean))  # noqa: B023, E731
        tops = index.select(F.array_max(F.transform("bounds", weight)).alias("a"), F.array_max(F.transform("postings", weight)).alias("b"), F.size("postings").alias("n"), F.col("n").alias("m"))
        assert tops.where("a <> b OR n <> m").isEmpty()


def test_best_probe_text_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]

    def phrase():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6)))

    cases = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else "c", phrase()) for i in range(120)], "case_no int, domain string, query string")
    probes = spark.createDataFrame([("ab"[i % 2], i, phrase()) for i in range(30)], "domain string, pos bigint, question string")
    one = sorted(map(tuple, coverage.best_probe_text(cases, probes, 0.3).select("case_no", "best_probe", "best_score", "covered").collect()))
    monkeypatch.setattr(coverage, "is_bounded", lambda df: False)
    monkeypatch.setattr(coverage, "PROBE_CHUNK", 4)
    two = sorted(map(tuple, coverage.best_probe_text(cases, probes, 0.3).select("case_no", "best_probe", "best_score", "covered").collect()))
    assert one == two


def test_spread_join_equals_a_plain_join(spark):
    rng = random.Random(4)
    big = spark.createDataFrame([(rng.choice("aaaaab") if i % 7 else None, i) for i in range(300)] + [("a", 5), ("a", 5)], "k string, n int")
    small = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k string, m int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = spread_join(big, small, ["k"], ["n"], how, parts=5)
        plain = big.join(small, "k", how)
        assert got.columns == plain.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        assert spread_join(big.limit(0), small, ["k"], ["n"], how).count() == 0
    with pytest.raises(ValueError):
        spread_join(big, small, ["k"], ["n"], "full")


def test_no_join_moves_a_large_side_by_its_busy_key_alone(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(50_000)
    outcomes = rows.select(F.col("id").alias("outcome_id"), F.lit("d").alias("domain"), F.lit(False).alias("correction_applied"))
    injections = rows.select(F.concat(F.lit("d"), F.col("id") % 9000).alias("domain"))
    runs = rows.select(F.concat(F.lit("m"), F.col("id") % 9000).alias("dbt_model"), at.alias("run_timestamp"), F.col("id").cast("string").alias("run_id"), F.lit("5").alias("rows_affected"), F.lit("v").alias("schema_version"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        for df in (V.tag_injection(outcomes, injections), silent_drop(runs), schema_drift(runs)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "SortMergeJoin [" in line or "HashJoin [" in line]
            spread = [line for line in joins if "_spread_part" in line]
            assert spread and not [line for line in joins if line not in spread and ("outcome_id" in line or "run_id" in line)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
