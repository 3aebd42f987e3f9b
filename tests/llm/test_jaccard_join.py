"""The n-gram Jaccard join against brute force, and the rows it keeps."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join
from tessera.llm.common import discard, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, k, num, den):
    """(size of each set, smallest place of each component)."""
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    return [len(s) for s in sets], top


def copies(rnd, n_texts, words, most_copies, passage=()):
    texts = []
    for _ in range(n_texts):
        t = [rnd.choice(words) for _ in range(rnd.randint(3, 90))]
        if passage and rnd.random() < 0.5:
            t[len(t) // 2 : len(t) // 2] = passage
        texts.append(" ".join(t))
        for _ in range(rnd.randint(0, most_copies)):
            u = list(t)
            for _ in range(rnd.randint(0, 3)):
                u[rnd.randrange(len(u))] = rnd.choice(words)
            texts.append(" ".join(u))
    return texts


def joined(spark, texts, k, num):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in jaccard_join.join_classes(materialize(df, "t"), k, num, 100).collect())


@pytest.mark.parametrize("run_rows", [8192, 8])
def test_against_brute_force(spark, monkeypatch, run_rows):
    monkeypatch.setattr(jaccard_join, "RUN_ROWS", run_rows)  # 8: most runs are dealt out again in blocks
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    rnd = random.Random(run_rows)
    words = [f"w{i}" for i in range(300)]
    texts = copies(rnd, 25, words, 14, [f"p{i}" for i in range(60)]) + ["", None, "x", "X", " ", "two words", "two  WORDS"]
    texts += [" ".join(f"p{i}" for i in range(60)) + f" e{j}" for j in range(30)]
    k, num = (4, 85) if run_rows > 8 else (5, 80)
    sizes, top = brute(texts, k, num, 100)
    assert joined(spark, texts, k, num) == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, top))]


def test_words_that_linear_hashes_confuse(spark):
    odd = lambda one, other: "".join(one if i.bit_count() % 2 == 0 else other for i in range(1024))
    same = " ".join(f"w{i}" for i in range(3))
    texts = [f"{same} {odd('a', 'b')}", f"{same} {odd('b', 'a')}", odd("a", "b"), odd("b", "a")]
    assert joined(spark, texts, 4, 85) == [(i, 1, i) for i in range(4)]


def test_long_texts(spark):
    base = [f"word{i * 7919 % 100_003}" for i in range(250_000)]
    near, far = list(base), list(base)
    near[5000:6000] = ["changed"] * 1000
    far[::20] = ["other"] * len(far[::20])
    assert [r[2] for r in joined(spark, [" ".join(t) for t in (base, near, far)], 5, 80)] == [0, 0, 2]


def test_rows_without_or_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    data = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (None, b, "n"), (None, a + " more", "n"), (7, "", "e"), (7, "", "f"), (None, None, "g"), (8, "alone", "h"), (8, "alone", "i")]
    df = spark.createDataFrame(data, "doc_id long, text string, rid string").withColumn("component", F.lit(1)).coalesce(1)
    stay = jaccard_join.one_of_each(materialize(df, "t"))
    assert stay.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in stay.collect()) == sorted([(1, a), (5, b), (7, ""), (7, ""), (0, ""), (8, "alone")])
    found = [tuple(r) for r in jaccard_join.join_classes(materialize(df, "t")).collect()]
    assert sorted(found, key=repr) == sorted(
        [(1, 36, 1), (5, 36, 1), (5, 36, 5), (None, 36, 5), (None, 37, 1), (7, 0, 7), (7, 0, 7), (None, 0, None), (8, 1, 8), (8, 1, 8)], key=repr
    )
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0 and jaccard_join.join_classes(df.limit(0)).count() == 0


def test_many_null_ids_stay_linear(spark):
    nulls = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some text here of number "), F.col("id").cast("string"), F.lit(" and more of it")).alias("text"))
    found = jaccard_join.join_classes(materialize(nulls, "t"))
    assert found.count() == 10_000
    assert jaccard_join.one_of_each(materialize(nulls, "t")).count() == 10_000


def test_signatures_bound_the_overlap():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 2**64, rnd.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([rnd.choice(a, rnd.integers(0, len(a) + 1)), rnd.integers(0, 2**64, rnd.integers(0, 900), dtype=np.uint64)]))
        if len(b):
            x, y = (jaccard_join._bits(jaccard_join.signature(s)) for s in (a, b))
            assert len(np.intersect1d(a, b)) <= jaccard_join.most_shared(len(a), x, y) <= len(a)


def test_sketch_finds_what_is_frequent():
    sketch = jaccard_join.Sketch()
    for i in range(9000):
        sketch.add(np.append(np.arange(i * 300, i * 300 + 300), [2**63, 5_000_000 + i % 7]).astype(np.uint64))
    sketch.fold()
    found = dict(zip(sketch.token.tolist(), sketch.count.tolist()))
    assert found[2**63] >= 8990 and all(found[5_000_000 + i] > 1200 for i in range(7)) and len(found) <= jaccard_join.SKETCH


def test_joins_by_row_number_move_no_text(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five "), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, sets, _ = jaccard_join._classified(materialize(df, "t"), 4, 85, 100, [], (1, 2))
        plan = rows.join(sets.select("rid", "n"), "rid")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        discard(rows, sets)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shingles_are_of_whole_words():
    texts = pa.array(["a b c d", "A  B\tc\nd", "ab c d", "a b cd", "a b c d e"])
    one, two, *others = (s.tolist() for s in jaccard_join.shingle_sets(texts, 4, 9))
    assert one == two and one[0] in jaccard_join.shingle_sets(texts, 4, 9)[4].tolist() and all(one != x for x in others)
