"""Quality rules, quality classifier, toxicity and URL filter: exact counts, held-out accuracy, hard rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veralytics.llm import quality_gam, quality_rules, toxicity, url_filter
from veralytics.llm.queries import QUERIES
from veralytics.llm.text_stats import BASE, FEATURES, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The contract's counts, one text at a time."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return [
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(hit),
    ]


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, labels.toPandas().set_index("doc_id")


def test_counts_match_brute_force(given, hard_docs):
    texts = [r["text"] for d in (given[0], hard_docs) for r in d.select("text").collect()]
    got = text_stats(texts)[BASE].to_numpy().tolist()
    assert got == [base(t) for t in texts]


def test_counts_with_repeats():
    text = "a b c d e f g h i\na b c d e f g h i\n\nx\na b c d e f g h i"
    assert text_stats([text])[BASE].iloc[0].tolist() == base(text) == [28, 28, 0, 2, 27]


def test_quality_rules_whole_table(spark):
    """Verdicts on documents whose labels the trees never saw; the smallest tables hold too few labels to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    unseen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] in quality.index]
    marked = [(r["kept"], quality[r["doc_id"]]) for r in unseen if not r["base_failed"]]
    assert len(marked) > 50 and sum(k == bool(q) for k, q in marked) >= 0.95 * len(marked)


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(FEATURES)))
    at = FEATURES.index("symbol_rate")
    y = (x[:, at] + 0.3 * rng.random(3000) < 0.6).astype(float)
    sign = np.array([quality_rules.MONOTONE.get(c, 0) for c in FEATURES])
    forest = quality_rules.grow(x, y, sign)
    for name, s in quality_rules.MONOTONE.items():
        grid = np.repeat(x[:20], 50, 0)
        grid[:, FEATURES.index(name)] = np.tile(np.linspace(0, 1, 50), 20)
        steps = np.diff(forest.score(grid).reshape(20, 50), axis=1)
        assert (s * steps >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair explains it
    model = quality_gam.boost(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


@pytest.mark.parametrize("name,label", [("op4_quality_classifier", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")[label]
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.7 if label == "quality" else 0.3))
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known.index]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_hard_rows(spark, given, hard_docs, no_docs):
    labels = given[1]
    for run in (quality_rules.judge, quality_gam.classify, toxicity.classify):
        rows = run(hard_docs, labels).collect()
        assert len(rows) == 10 and len({str(r) for r in rows if r["doc_id"] == 5}) == 1
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, None, 7, 8, 9}
        assert run(no_docs, labels).count() == 0
        assert run(hard_docs, labels.limit(0)).count() == 10
    kept = quality_rules.keep_good(hard_docs, labels)
    assert kept.columns == hard_docs.columns and quality_rules.keep_good(no_docs, labels).count() == 0


def test_keep_good_agrees_with_judge(given):
    kept = {r["doc_id"] for r in quality_rules.keep_good(given[0], given[1]).select("doc_id").collect()}
    judged = {r["doc_id"] for r in quality_rules.judge(given[0], given[1]).where("kept").collect()}
    assert kept == judged


def test_keep_good_agrees_where_labels_name_other_documents(given):
    some = given[0].where("doc_id % 2 = 0")
    kept = sorted(r["doc_id"] for r in quality_rules.keep_good(some, given[1], rows=30).select("doc_id").collect())
    assert kept == sorted(r["doc_id"] for r in quality_rules.judge(some, given[1], rows=30).where("kept").collect())


def _rule(host, path):
    found = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found, key=lambda r: len(r[0]), default=(None, None))


def test_url_rules(spark, sf_dir):
    urls = [
        None, "", "no scheme", "http://ORG", "http://x.org/", "x://Example.ORG/es/a?b", "http://example.org/en/12#c", "http://a.b.com/fr/x://y",
        "http://com/de/", "http://notexample.org/es/", "http://a.com?/fr/", "http://a.net/\n/x", "http://a.org:80/es/",
    ]
    real = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame(list(enumerate(urls + real)), "page_id long, url string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(urls + real)
    for r in rows:
        url = (urls + real)[r["page_id"]]
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        rule, verdict = _rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_markov_ratio_tells_kinds_apart():
    good = [f"https://news.example/{i}/article" for i in range(200)]
    bad = [f"http://xx{i}.win/free-casino?q={i}" for i in range(200)]
    model = url_filter.Ratio(url_filter.Markov.of(good[::2]), url_filter.Markov.of(bad[::2]))
    model.least = url_filter.threshold(model.score(good[1::4]), model.score(bad[1::4]))
    assert (model.score(good[3::4]) >= model.least).all() and (model.score(bad[3::4]) < model.least).all()


def test_markov_probabilities_sum_to_one():
    model = url_filter.Markov.of(["abcabd", "abe"])
    context, _, _ = url_filter._grams(["ab"])
    total = 0.0
    for c in range(256):
        ctx, joint, _ = url_filter._grams(["ab" + chr(c)])
        if chr(c) != "\x03":
            total += np.exp(model.log_likelihood(ctx, joint)[2])
        else:
            ctx, joint, _ = url_filter._grams(["ab"])
            total += np.exp(model.log_likelihood(ctx, joint)[2])
    assert abs(total - 1) < 1e-6


def test_url_models_count_all_urls(spark):
    """Scores are those of models over all judged URLs that do not calibrate, more of them than the models once took."""
    urls = [f"https://x.org/{i % 97}/a{i}" for i in range(21_000)] + [f"http://y.com/de/{i}?b" for i in range(400)] + [f"ftp://z.net/{i}é" for i in range(20)] + [None, "", "no url"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:5])], "page_id long, url string")
    hashed = pages.selectExpr("page_id", "pmod(xxhash64(coalesce(url, '')), 5) AS fold").collect()
    counted = {urls[r.page_id] for r in hashed if r.page_id < len(urls) and r.fold and urls[r.page_id]}
    sides = [sorted(u for u in counted if mark in u) for mark in ("x.org", "y.com")]
    model = url_filter.Ratio(url_filter.Markov.of(sides[0]), url_filter.Markov.of(sides[1]))
    rows = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(rows) == len(urls) + 5
    picked = [*range(0, 21_000, 500), *range(21_000, len(urls) + 5)]
    expected = model.score([(urls + urls[:5])[i] for i in picked])
    assert np.allclose([rows[i].score for i in picked], expected)
    free = [i for i in picked if rows[i].rule is None]
    cuts = [rows[i].score for i in free if rows[i].verdict == "allow"], [rows[i].score for i in free if rows[i].verdict == "block"]
    assert not cuts[0] or not cuts[1] or min(cuts[0]) > max(cuts[1])
