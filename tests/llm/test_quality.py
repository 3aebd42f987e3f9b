"""Quality rules and classifier against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_gbt, quality_rules
from tessera.llm.common import materialize
from tessera.llm.textstats import FEATURES

D = len(quality_rules.VECTOR)
FLOOR2 = np.diag(np.square(quality_rules.FLOOR))
FACTOR = quality_rules._consistency(0.75, D)


def grid_median(cells):
    cells = np.sort(cells)
    return cells[(len(cells) + 1) // 2 - 1] / quality_rules.GRID


def step(x, centre, cov):
    """The nearest three quarters, ties by vector, and their mean and covariance."""
    u = x - centre
    d2 = np.einsum("ni,ij,nj->n", u, np.linalg.inv(cov + FLOOR2), u)
    near = np.lexsort([*x.T[::-1], d2])[: -(-len(x) * 3 // 4)]
    return x[near].mean(0), np.cov(x[near].T, bias=True) * FACTOR


def logdet(cov):
    return np.linalg.slogdet(cov + FLOOR2)[1]


def settle(x, centre, cov):
    last = np.inf
    while True:
        centre, cov = step(x, centre, cov)
        if last - logdet(cov) <= quality_rules.SETTLED:
            return logdet(cov), centre, cov
        last = logdet(cov)


def plain(x):
    """The best of the four starts, all followed to their ends."""
    grid = np.round(x * quality_rules.GRID)
    median = np.array([grid_median(c) for c in grid.T])
    mad = np.array([grid_median(np.abs(c - round(m * quality_rules.GRID))) for c, m in zip(grid.T, median)])
    unit = np.sqrt(np.square(mad * 1.4826) + np.square(quality_rules.FLOOR))
    z, outer = (x - median) / unit, np.outer(unit, unit)

    def correlation(c):
        s = np.sqrt(np.diag(c))
        flat = s < 1e-9
        s[flat] = 1
        c = c / np.outer(s, s)
        c[flat, :] = c[:, flat] = 0
        c[range(D), range(D)] = 1
        return c

    t, r = np.tanh(z), z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)
    starts = [
        (median, outer * np.eye(D)), (median + unit * z.mean(0), outer * np.cov(z.T, bias=True)), (median, outer * correlation(np.cov(t.T, bias=True))), (median, outer * correlation(r.T @ r / len(r))),
    ]
    return min((settle(x, *s) for s in starts), key=lambda f: f[0])


@pytest.fixture(scope="module")
def groups():
    """Contaminated groups, small and large, with ties and with constant coordinates."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=(D, D)) * 0.1
    clean = lambda n: rng.normal(size=(n, D)) @ a + 1.0
    far = lambda n: rng.normal(size=(n, D)) * 0.02 + rng.normal(size=D) * 2 + 3
    found = {1: np.concatenate([clean(500), far(120)]), 2: np.concatenate([clean(24), far(6)]), 3: clean(7), 4: np.repeat(clean(40), 5, 0), 5: clean(1)}
    found[6] = np.concatenate([np.round(clean(300), 1), np.repeat(far(1), 60, 0)])
    found[6][:, 3] = 0.25
    return found


def test_determinant_is_the_smallest(spark, groups):
    data = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    rows = spark.createDataFrame(data, ["gid", *quality_rules.VECTOR]).groupBy("gid", *quality_rules.VECTOR).agg(F.count(F.lit(1)).alias("w"))
    rows = materialize(rows, "t")
    found = {r.gid: r for r in quality_rules.concentrated(rows, 0.75, go_on=4).collect()}
    usual = {r.gid: r for r in quality_rules.concentrated(rows, 0.75).collect()}
    rng = np.random.default_rng(5)
    for g, x in groups.items():
        if len(x) == 1:
            assert np.allclose(found[g].centre, x[0])
            continue
        wanted = plain(x)
        assert wanted[0] - 1e-5 <= usual[g].logdet <= wanted[0] + 0.2
        assert found[g].logdet == pytest.approx(wanted[0], abs=1e-5)
        assert np.allclose(found[g].centre, wanted[1], atol=1e-5)
        assert np.allclose(np.array(found[g].inverse).reshape(D, D), np.linalg.inv(wanted[2] + FLOOR2), rtol=1e-3, atol=1e-3)
        subsets = (x[rng.choice(len(x), min(len(x), D + 1), replace=False)] for _ in range(40))
        tried = min(settle(x, s.mean(0), np.cov(s.T, bias=True))[0] for s in subsets)
        # concentration ends in local minima: none of 40 random starts does much better, in a small group not by far
        assert found[g].logdet <= tried + (0.05 if len(x) > 100 else 0.2)


def test_rules_on_odd_tables(spark, docs):
    same = docs.withColumns({"n_words": F.lit("clash"), "kept": F.lit("clash"), "k_doc_id": F.lit(1), "gid": F.lit("g")})
    found = quality_rules.assess(same, keep=["doc_id", "n_words", "kept", "gid"])
    assert found.columns.count("n_words") == 1 and found.columns.count("kept") == 1 and found.count() == docs.count()
    assert {r.gid for r in found.collect()} == {"g"} and dict(found.dtypes)["n_words"] == "bigint"
    stay = quality_rules.accepted(same)
    assert stay.columns == same.columns and stay.count() == found.where("kept").count()
    assert quality_rules.accepted(docs.limit(0)).count() == 0
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("a few words that are the same in every text but for one number near the end of it, as here: "), F.col("id") % 3, F.lit(" so far")).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert quality_rules.assess(many).where("kept").count() == 600  # ties everywhere


def test_best_split_is_found():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = rng.integers(0, 6, (60, 3)).astype(float)
        y = (x[:, rng.integers(3)] + rng.normal(size=60) > 2.5).astype(float)
        trees = quality_gbt.fit(x, y, rounds=1, depth=1, leaf_rows=5)
        p = np.clip(y.mean(), 0.01, 0.99)
        g, h = p - y, np.full(60, p * (1 - p))
        best = max(
            ((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)) for f in range(3) for c in range(5) for m in [x[:, f] <= c + 0.5] if 5 <= m.sum() <= 55), default=None
        )
        root = trees.roots[0]
        left = x[:, trees.feature[root]] <= trees.threshold[root]
        assert g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) == pytest.approx(best)


def test_sample_is_bounded(spark):
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    sample = quality_gbt.sampled_labels(labels, F.lit(True), max_rows=2000)
    assert 1800 < sample.count() < 2200 and sample.collect() == sample.collect()
    assert quality_gbt.sampled_labels(labels, quality_gbt.learnable(), max_rows=10**6).count() == labels.where(quality_gbt.learnable()).count()


def test_classifier_on_odd_tables(spark, docs):
    kind = "doc_id long, quality int"
    texts = [(i, ("good words, in a line. " if i % 2 else "### $$$ ||| ") * (3 + i % 5)) for i in range(200)] + [(3, "### again"), (None, "none"), (7, None), (9, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit("clash"), "log_words": F.lit("clash"), "y": F.lit(5), "quality": F.lit(0)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(11, 0), (13, None), (15, 7), (None, 1), (10**6, 1)], kind)  # 11 is told both
    stats = quality_gbt.document_features(d, ["doc_id"])
    sample = {r.doc_id: r.y for r in quality_gbt.sampled_labels(labels, quality_gbt.learnable()).collect()}
    assert 11 not in sample and sample.get(15, 1) == 1 and all(y == i % 2 for i, y in sample.items() if i is not None and i < 200)
    one, two = quality_gbt.train(stats, labels, quality_gbt.learnable()), quality_gbt.train_on_documents(d, labels, quality_gbt.learnable())
    found = {(r.doc_id, r.score) for r in quality_gbt.score(stats, one).collect()}
    assert found == {(r.doc_id, r.score) for r in quality_gbt.score(stats, two).collect()}
    assert quality_gbt.score(stats, one).where("doc_id = 3").count() == 2 and len({i for i, _ in found}) == len({i for i, _ in texts})
    assert np.mean([(s >= 0.5) == (i % 2 == 1) for i, s in found if i is not None]) > 0.95
    nothing = quality_gbt.train(stats, labels.limit(0), quality_gbt.learnable())
    assert {r.score for r in quality_gbt.score(stats, nothing).collect()} == {0.5}
    empty = quality_gbt.document_features(d.limit(0), ["doc_id"])
    assert quality_gbt.score(empty, quality_gbt.train(empty, labels, quality_gbt.learnable())).count() == 0
    stay = quality_gbt.accepted(d, one)
    assert stay.columns == d.columns and 0 < stay.count() < d.count()
    assert len(FEATURES) == len(set(FEATURES))


def test_estimates_stay_few_files_whatever_the_partitions(spark):
    """Else their footers pass for a large table, and every step shuffles all rows by group."""
    rng = np.random.default_rng(5)
    x = rng.normal(1, 0.2, (2000, D))
    data = [(i % 50, *map(float, v), 1) for i, v in enumerate(x)]
    rows = materialize(spark.createDataFrame(data, ["gid", *quality_rules.VECTOR, "w"]), "test-rows")
    usual = {(r.gid, r.start): r for r in quality_rules._step(rows, materialize(quality_rules._starts(rows), "test-starts"), 0.75, FACTOR).collect()}
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        starts = materialize(quality_rules._starts(rows), "test-starts")
        new = materialize(quality_rules._step(rows, starts, 0.75, FACTOR), "test-step")
        assert len(starts.inputFiles()) <= 4 and len(new.inputFiles()) <= 4
        found = {(r.gid, r.start): r for r in new.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.keys() == usual.keys() and len(found) == 200
    for key, r in found.items():
        np.testing.assert_allclose(r.centre, usual[key].centre, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(r.inverse, usual[key].inverse, rtol=1e-6, atol=1e-6)
