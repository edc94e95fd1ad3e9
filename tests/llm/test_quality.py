"""Boosted trees against plain ones, statistics of poor texts, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import quality as Q


def walked(model, row):
    """The score of one row by going down tree after tree."""
    total = model.base
    for t in range(len(model.feature)):
        i = 0
        while i < model.feature.shape[1]:
            f = model.feature[t, i]
            b = sum(1 for e in model.edges[f] if e < row[f])
            i = 2 * i + (2 if b > model.bin[t, i] else 1)
        total += model.leaf[t, i - model.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_walked_ones():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 5)), np.zeros((3, 5)), rng.integers(0, 3, (100, 5))])
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit_trees(x, y, trees=25, depth=3, bins=16)
    assert np.allclose(model.scores(x), [walked(model, r) for r in x], rtol=0, atol=1e-12)
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.9


def test_first_split_is_the_best():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)).round(1), rng.integers(0, 2, 200).astype(float)
    y[x[:, 1] > 0.4] = 1
    model = Q.fit_trees(x, y, trees=1, depth=1, bins=256)
    p = 1 / (1 + np.exp(-model.base))
    g, h = y - p, np.full(200, p * (1 - p))
    gains = {}
    for f in range(3):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) >= Q.LEAST:
                gains[f, cut] = sum(g[m].sum() ** 2 / (h[m].sum() + Q.RIDGE) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + Q.RIDGE)
    f = model.feature[0, 0]
    assert (gains[f, model.edges[f][model.bin[0, 0]]]) == pytest.approx(max(gains.values()))
    left = x[:, f] <= model.edges[f][model.bin[0, 0]]
    assert np.allclose(model.leaf[0], [Q.RATE * g[m].sum() / (h[m].sum() + Q.RIDGE) for m in (left, ~left)])


def test_statistics_of_any_text():
    for text in (None, "", " ", "\n", "\n" * 1000, "a", "\ud800 x", "日本語。", "x" * 3_000_000, "! " * 500_000, "\x00\x01"):
        s = Q.statistics(text)
        assert len(s) == len(Q.STATISTICS) and np.isfinite(s).all()
    of = dict(zip(Q.STATISTICS, Q.statistics("AB cd.\nAB cd.\n1! x")))
    assert of["repeated_lines"] == pytest.approx(1 / 3) and of["ended_lines"] == pytest.approx(2 / 3) and of["caps_words"] == pytest.approx(2 / 6)
    assert of["digit_share"] == pytest.approx(1 / 18) and of["distinct_words"] == pytest.approx(4 / 6) and of["sentence_words"] == pytest.approx(6 / 4)


def test_poor_rows(spark):
    docs = spark.createDataFrame([(1, "Fine words here."), (1, "Fine words here."), (None, None), (3, ""), (4, "### $$$ %%%" * 50)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "lang": F.lit("en")})
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (4, 1), (3, None), (None, 1), (9, 0)], "doc_id long, quality int")
    sample = Q.labelled_sample(docs, labels).collect()
    assert [(r["doc_id"], r["label"]) for r in sample] == [(1, 1)]  # 4 has both labels, 9 no text; 1 counts once
    got = Q.with_quality(docs, Q.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["lang"] == "en" for r in got)
    none = Q.train(docs, labels.limit(0))
    assert {r["score"] for r in Q.with_quality(docs, none).collect()} == {0.5}
    assert Q.with_quality(docs.limit(0), none).collect() == []
    assert Q.labelled_sample(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"), rows=2).count() <= 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in Q.op13_boosted_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs
    true = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r, q) for r, q in true if r["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.97
    low, high = max(r["score"] for r, q in held if q == 0), min(r["score"] for r, q in held if q == 1)
    assert low < high + 0.2
