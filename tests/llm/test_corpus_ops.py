"""Mixing, exact top-k, the Jaccard join and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veralytics.llm import jaccard_join, mixing, pii, vector_topk
from veralytics.llm.components import components
from veralytics.llm.jaccard_join import Join


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([1, 100, 199], [1, 2, 3]) == pytest.approx([3, 118.8, 178.2])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_splitting_tree_keeps_quotas():
    quotas = np.array([5, 0, 17, 102])
    parts = mixing.split_quotas(quotas, 13, np.random.default_rng(3))
    assert (parts.sum(0) == quotas).all() and parts.shape == (13, 4)
    assert parts.sum(1).max() - parts.sum(1).min() <= 2


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.drawn(docs).toPandas()
    source = docs.select("doc_id", "source").toPandas().set_index("doc_id").source
    by = rows.groupby(rows.doc_id.map(source)).agg(size=("size", "sum"), whole=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    expected = mixing.targets(by["size"].tolist(), [(1, 2, 3)[i % 3] for i in range(len(by))])
    assert (by["size"] == by["whole"]).all() and np.allclose(by["target"], expected)
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"]).all()
    assert (rows["taken"] <= 3 * rows["size"]).all() and len(rows) == docs.count()
    again = mixing.drawn(docs.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix(docs).count() == int((rows["taken"] / rows["size"].clip(lower=1)).sum())


def test_mix_of_hard_rows(hard_docs, no_docs):
    rows = mixing.drawn(hard_docs).collect()
    assert len(rows) == 10 and {r["source"] for r in rows} == {"a", "b", "c", "d", None}
    assert all(r["taken"] <= 3 * r["size"] for r in rows) and mixing.drawn(no_docs).count() == 0
    assert mixing.mix(hard_docs).columns == hard_docs.columns and mixing.mix(no_docs).count() == 0


def _brute_top(rows, k, step):
    ints = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
            ints.append((i, [min(max(x, -(2**63)), 2**63 - 1) for x in whole]))
    out = []
    for n, (q, qv) in enumerate(ints):
        if q % step == 0:
            score = lambda v: min(max(sum(a * b for a, b in zip(qv, v, strict=False)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
            best = sorted((-score(v), c) for m, (c, v) in enumerate(ints) if m != n)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # one very common vector
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, []), (505, [3.0])]
    rows += [rows[0], (100, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector_topk, "SAMPLE", 40)
    monkeypatch.setattr(vector_topk, "PIVOTS", 7)
    monkeypatch.setattr(vector_topk, "DATA_BLOCK", 50)
    monkeypatch.setattr(vector_topk, "QUERY_BLOCK", 4)
    got = sorted(tuple(r) for r in vector_topk.top_k(df, 10, 20).collect())
    assert got == _brute_top(rows, 10, 20)
    rows += [(600, [1e30] * 6), (620, [-1e30, 1.0, 0.0, 0.0, 0.0, 0.0]), (601, [3e15] * 6), (640, [-2e15] * 6)]  # large but finite
    large = spark.createDataFrame(rows, df.schema)
    assert sorted(tuple(r) for r in vector_topk.top_k(large, 10, 20).collect()) == _brute_top(rows, 10, 20)
    few = spark.createDataFrame(rows[:3], df.schema)
    assert sorted(tuple(r) for r in vector_topk.top_k(few, 10, 2).collect()) == _brute_top(rows[:3], 10, 2)
    assert vector_topk.top_k(df.limit(0)).count() == 0


def test_cells_merge_into_few_groups():
    pivots = np.arange(12).reshape(6, 2)
    assert vector_topk.merged_cells(pivots, {0: 3, 1: 3, 2: 3, 4: 20, 5: 1}, 10) == {0: 0, 1: 0, 2: 0, 4: 1, 5: 2}
    assert vector_topk.merged_cells(pivots, {}, 10) == {}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in links if a != b for n in (a, b)}


def _shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_join(rows, k, percent):
    """Rows that repeat a doc_id are rows of their own."""
    sets = sorted(((i, _shingles(t, k)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        for x in s:
            holders[x].append(n)
    near = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in near:
        (i, s), (j, t) = sets[a], sets[b]
        if None not in (i, j) and 100 * len(s & t) >= percent * len(s | t):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else sets[root(n)][0]) for n, (i, s) in enumerate(sets)), key=str)


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k,percent,block", [(3, 90, 2048), (3, 90, 8), (5, 80, 8), (3, 50, 16)])
def test_join_matches_brute_force(spark, sf_dir, make_docs, hard_docs, monkeypatch, k, percent, block):
    """Also with blocks so small that families need pivots, rounds and blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))] for _ in range(4)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [_edited(rng, b, rng.randrange(1, 5)) for b in base for _ in range(25)] + [" ".join(base[0])] * 6
    texts += [passage + " " + " ".join(f"u{i}x{j}" for j in range(20)) for i in range(25)] + ["A b", "a B", "a b c", "a"]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120").collect()]
    hard = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    got = jaccard_join.join(make_docs(rows + real + hard), k, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows + real + hard, k, percent)


def test_sketch_never_drops_a_link():
    rng = np.random.default_rng(2)
    for n in (5, 9, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[max(1, n // 20) :], rng.integers(0, 2**63, max(0, n // 25)).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        import pandas as pd

        region = pd.DataFrame({"node": [1, 2], "n_shingles": [len(a), len(b)], "sketch": [jaccard_join.sketch(x).tobytes() for x in (a, b)]})
        if 100 * inter >= 90 * (len(a) + len(b) - inter):
            assert jaccard_join.near_pairs(region, 90) == [(2, 1)]


def test_clusters_join_all_sets_that_places_leave_linkable():
    """Against all pairs, with rows that come in several batches."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        percent, rows = int(rng.choice([50, 80, 90, 100])), {}
        for token, node in rng.integers(0, [3, 12], (20, 2)):
            size = int(rng.integers(1, 60))
            place = int(rng.integers(0, len(jaccard_join.place_spans(size, percent))))
            rows[int(token), int(node)] = (int(jaccard_join.place_spans(size, percent)[place]), size, place)
        order = sorted((t, span, n) for (t, n), (span, _, _) in rows.items())
        got, state, at = set(), [], 0
        while at < len(order):
            end = at + int(rng.integers(1, 8))
            batch = np.array([*state, *((t, n, span) for t, span, n in order[at:end])], np.int64)
            lead, node, last = jaccard_join.clustered(*batch.T)
            got |= set(zip(lead.tolist(), node.tolist(), strict=True))
            state, at = [last] if last else [], end
        expected = set()
        for token in {t for t, _ in rows}:
            left = [n for t, _, n in order if t == token]
            while left:
                part = [left.pop(0)]
                for x in part:
                    for y in left[:]:
                        (_, a, i), (_, b, j) = rows[token, x], rows[token, y]
                        shared = min(a - i, b - j)
                        if 100 * shared >= percent * (a + b - shared):
                            part.append(y)
                            left.remove(y)
                if len(part) > 1:
                    first = min(part, key=lambda n: (rows[token, n][0], n))
                    expected |= {(first, n) for n in part}
        assert got == expected


def test_sets_of_unlike_sizes_form_no_region(make_docs):
    """A shared rare shingle alone brings sets together only if they may be linked."""
    texts = ["a b c " + " ".join(f"x{n}y{i}" for i in range(n)) for n in (20, 40, 80, 160)]
    assert Join(make_docs(list(enumerate(texts))))._regions().count() == 0
    texts.append("a b c " + " ".join(f"x160y{i}" for i in range(159)))
    assert Join(make_docs(list(enumerate(texts))))._regions().select("node").distinct().count() == 2


def test_a_set_in_many_rows_is_compared_once(make_docs, monkeypatch):
    """Rows that repeat a doc_id and its text in several partitions."""
    words = [f"w{i}" for i in range(60)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words[:59]))])
    docs = docs.union(docs).union(docs).repartition(5)
    assert [r["component_id"] for r in jaccard_join.join(docs).collect()] == [1] * 6
    monkeypatch.setattr(jaccard_join, "solve_family", lambda family, percent: [(len(family), 0)])
    assert [r["a"] for r in Join(docs).links().collect()] == [2]


def test_one_of_each(hard_docs, no_docs, make_docs):
    rows = jaccard_join.one_of_each(hard_docs, 5, 80)
    assert rows.columns == hard_docs.columns
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == sorted(map(str, [1, 2, 3, 4, None, 7, 8, 9]))
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(make_docs([(5, "a b c"), (5, "a b c"), (6, "x y")])).collect()) == [5, 6]
    assert jaccard_join.one_of_each(no_docs).count() == 0 and Join(no_docs).classes().count() == 0


def test_pipeline(spark, sf_dir, tmp_path):
    """Each stage against brute force on its own input."""
    from test_text_ops import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert docs.columns == inputs["quality_rules"].columns
    inputs["end"] = docs
    text = {n: [(r["doc_id"], r["text"]) for r in d.collect()] for n, d in inputs.items() if n != "end"}
    joined = brute_join(text["jaccard_join"], corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert sorted(i for i, _ in text["pseudonyms"]) == sorted({c for _, _, c in joined})
    assert sorted(text["source_mixing"]) == sorted((i, brute(t)[0]) for i, t in text["pseudonyms"])
    assert set(text["sentencepiece"]) <= set(text["source_mixing"])
    assert docs.count() == len(text["sentencepiece"]) and docs.where("NOT round_trip").isEmpty()
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_keep_columns_of_any_name_and_type(make_docs):
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "mail x@example.com now", None), (3, None, "b")]
    odd = {"a.b": F.lit("dot"), "row": F.lit(1), "draw": F.lit("d"), "_mix_draw": F.lit("m"), "key`": F.lit(2), "m": F.create_map(F.lit("k"), F.lit("v"))}
    docs = make_docs(rows)
    for name, value in odd.items():
        docs = docs.withColumn(name, value)
    for run in (mixing.mix, pii.without_private, jaccard_join.one_of_each):
        out = run(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        found = out.collect()
        assert found and {(r["a.b"], r["row"], r["draw"], r["_mix_draw"], r["key`"], r["m"]["k"]) for r in found} == {("dot", 1, "d", "m", 2, "v")}
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()) == [1, 2, 3]
