"""Each operator against brute force, round trips and held-out labels, on small and awkward inputs."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, license_scan, linkgraph, mixing, quality_gbt, quality_rules, token_files, vamana, warc
from tessera.llm import sentencepiece_bpe as sp
from tessera.llm.common import scratch_path
from tessera.llm.components import components
from tessera.llm.queries import tokenizer_path
from tessera.llm.textstats import repeated_words, rule_stats

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sentencepiece_is_the_librarys(spark, docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib, own, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sp.codec(path), random.Random(3)
    for _ in range(1500):
        t = "".join(rnd.choice("abcdeéß     \n\t.,|▁漢字가ab\U0001f600\x00<0x41>") for _ in range(rnd.randint(0, 60)))
        assert own.encode(t) == lib.encode(t) and own.decode(own.encode(t)) == lib.decode(lib.encode(t))
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3)]) for _ in range(rnd.randint(0, 9))]
        assert own.decode(ids) == lib.decode(ids)
    found = sp.encode(docs, path, "text", ids="ids", decoded="decoded")
    assert len(found.columns) == len(docs.columns) + 1  # the clashing column is replaced
    for r in found.collect():
        assert r.ids == lib.encode(r.text or "") and r.decoded == lib.decode(r.ids)
    again = sp.decode(found.select("ids"), path)
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in found.collect())
    assert sp.encode(docs.limit(0), path).count() == 0


def test_sentencepiece_short_segments_walk_together(monkeypatch):
    import sentencepiece

    path, rnd, alone = tokenizer_path("piece_bpe_32k.model"), random.Random(9), []
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sp.Codec(open(path, "rb").read())
    monkeypatch.setattr(own, "backtrack", lambda s, walk=own.backtrack: alone.append(s) or walk(s))
    words = ["".join(rnd.choice("aeinrsthé漢\x01") for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(300)] + ["", "a" * 70, "\n\t \U0001f600", words[0] * 40]

    def check():
        ids, bounds = own.encode_all(texts)
        wanted = [lib.encode(t) for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == wanted
        assert own.decode_all(ids, bounds).to_pylist() == [lib.decode(w) for w in wanted]

    check()
    assert all(len(s) > sp.CACHED_LENGTH for s in alone) and len(set(alone)) < 10  # one walk a segment before
    for name, value in (("GROUP", 50), ("WALKERS", 7), ("CHUNK", 9), ("CACHED_LENGTH", 5), ("CACHE_SEGMENTS", 40), ("CACHE_PAIRS", 300)):
        monkeypatch.setattr(sp, name, value)
        own.forget()
        check()


def test_sentencepiece_decodes_many_at_once():
    import sentencepiece

    path, rnd = tokenizer_path("piece_bpe_32k.model"), random.Random(10)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sp.codec(path)
    whole = lib.encode("\U0001f600")  # a character's bytes dealt over two lists are no character
    for lists in ([], [[]], [[], [5000], []], [whole[:2], whole[2:]], [[1, 2], [1, 29871, 306], [306]], *(
        [[rnd.choice([rnd.randrange(32000), rnd.randrange(131, 259), rnd.randrange(3)]) for _ in range(rnd.randint(0, 6))] for _ in range(5)] for _ in range(100)
    )):
        bounds = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        assert own.decode_all(np.array([i for x in lists for i in x], np.int32), bounds).to_pylist() == [lib.decode(x) for x in lists]


def _plain_scan(text, templates, threshold):
    def pairs(t):
        w = re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower())
        return {(w[i], w[i + 1]) for i in range(len(w) - 1)}

    scores = []
    for part in [text or "", *(text or "").split("\n")]:
        for place, (name, t) in enumerate(templates.items()):
            a, b = pairs(part), pairs(t)
            if a and b and (dice := 2 * len(a & b) / (len(a) + len(b))) >= threshold:
                scores.append((-dice, place, name))
    return (min(scores)[2], -min(scores)[0]) if scores else (None, 0.0)


def test_license_scan(spark, docs):
    rnd = random.Random(8)
    known = license_scan.TEMPLATES
    words = sorted({w for t in known.values() for w in t.split()}) + ["x", "LICENSE", "3.0.1", "_"]
    texts = ["", None, "MIT", "....", "Licensed", *known.values(), "\n".join(known.values()), " ".join(known.values()) * 50, "Released under the MIT License. " * 400]
    for _ in range(500):
        w = rnd.choice(list(known.values())).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words).upper()
        w += [rnd.choice(words) for _ in range(rnd.choice([0, 0, 1, 30]))]
        texts.append("\n".join(rnd.sample([" ".join(w), "some other line", "", "a"], 3)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for threshold in (0.5, 0.8, 1.0):
        found = {r.doc_id: (r.license, r.dice) for r in license_scan.scan(df, threshold=threshold).collect()}
        assert found == {i: _plain_scan(t, known, threshold) for i, t in enumerate(texts)}
    assert {r.license for r in license_scan.scan(df).collect()} == {None, *known}
    assert {tuple(r)[1:] for r in license_scan.scan(docs.withColumn("license", F.lit(1))).collect()} == {(None, 0.0)} and license_scan.scan(docs).count() == docs.count()
    assert {r.license for r in license_scan.scan(df, {}).collect()} == {None} and license_scan.scan(df.limit(0)).count() == 0


def test_mixing(spark, docs):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    by = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.target, []).append(r)
    assert sum(r.size for r in found if r.doc_id == 9) == len(WORD.findall("a\x0bb\x0cc\xa0d e\x1cf"))
    for target, rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= 16
    assert rows(mixing.mix(docs).orderBy("doc_id", "size")) == rows(mixing.mix(docs).orderBy("doc_id", "size"))
    assert mixing.mix(docs.limit(0)).count() == 0
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in whole.collect()) == sum(r.taken for r in found)


def test_sainte_lague(spark):
    votes = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 1.0, "e": 0.0}
    for seats in (0, 1, 7, 100, 1001):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            won[max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -ord(k)))] += 1
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k string, v double, s long")
        assert {r.k: r.out for r in mixing.sainte_lague(df, ["g"], "k", "v", "s", "out").collect()} == won


def test_quality_classifier(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality_gbt.document_features(d, ["doc_id"])
    trees = quality_gbt.train(stats, labels, quality_gbt.learnable())
    held = quality_gbt.score(stats, trees).join(labels, "doc_id").where(~quality_gbt.learnable()).toPandas()
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.95
    awkward = quality_gbt.score(quality_gbt.document_features(docs, ["doc_id"]), trees).collect()
    assert len(awkward) == docs.count() and all(0 <= r.score <= 1 for r in awkward)
    x = np.random.default_rng(0).normal(size=(50, len(quality_gbt.FEATURES)))
    for i, row in enumerate(x):  # flat arrays against a plain walk
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert trees.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -40, 40))))
    assert quality_gbt.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5


def _brute_classes(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return sets, [top(i) for i in range(len(sets))]


def test_license_windows(spark):
    from tessera.llm.queries import queries

    known = license_scan.LICENSES
    wrap = lambda t, n: "\n * ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    cases = [("some words before " + wrap(t, 7) + "\nand more words after it " * 9, name) for name, t in known]
    cases += [
        ("This work is licensed under the\nGNU General Public License, version 3.", "GPL-3.0"),
        ("Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This software is released under the MIT License.", "MIT"), ("", None), (None, None), ("no licence at all " * 40, None), ("Licensed", None),
    ]
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause")):
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            cases.append((open(path).read(), name))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    found = {r.doc_id: (r.license, r.dice) for r in license_scan.scan_windows(df).collect()}
    assert [found[i][0] for i in range(len(cases))] == [name for _, name in cases]
    assert all(found[i][1] == 1.0 for i in range(len(known)))
    same = sorted(map(repr, rows(queries()["op2_license_scan"](spark, DIR))))
    assert same == sorted(map(repr, rows(license_scan.scan(spark.read.parquet(f"{DIR}/documents.parquet")))))


def test_jaccard_join(spark, docs):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        t = [rnd.choice(words) for _ in range(rnd.randint(3, 90))]
        texts.append(t)
        for _ in range(rnd.randint(0, 14)):
            u = list(t)
            for _ in range(rnd.randint(0, 3)):
                u[rnd.randrange(len(u))] = rnd.choice(words)
            texts.append(u)
    texts = [" ".join(t) for t in texts] + ["", None, "x", "X", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, num in ((4, 85), (5, 80)):
        sets, root = _brute_classes(texts, k, num, 100)
        assert sorted(rows(jaccard_join.join_classes(df, k, num, 100))) == [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]
    assert jaccard_join.one_of_each(df, 5, 80, 100).count() == len(set(root))
    found = jaccard_join.join_classes(docs.select("doc_id", "text"), 4, 85, 100).collect()
    assert len(found) == docs.count()
    assert {r.doc_id: r.component_id for r in found if r.doc_id} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    assert jaccard_join.join_classes(df.limit(0), 4, 85, 100).count() == 0


def test_shingles_do_not_cross_texts():
    texts = pa.array(["a b", "c d", None, "", " e", "f "])
    alone = [jaccard_join.shingle_sets(pa.array([t], pa.string()), 2)[0].tolist() for t in texts.to_pylist()]
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts, 2)] == alone
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts.slice(1, 4), 2)] == alone[1:5]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    found = dict(rows(components(spark.createDataFrame(chain, "u long, v long"))))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    name = tokenizer_path("word_bpe_49k.json")
    lib, path = Tokenizer.from_file(name), scratch_path(spark, "t")
    token_files.write(docs, path, name)
    stored = token_files.checksums(token_files.read(spark, path)).join(token_files.starts(spark, path), ["part", "seq"]).orderBy("part", "seq").collect()
    assert [r.doc_id for r in stored] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    texts = {r.doc_id: r.text for r in docs.collect()}
    start = 0
    for r in stored:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_word_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    name, rnd = tokenizer_path("word_bpe_49k.json"), random.Random(6)
    lib, own = Tokenizer.from_file(name), token_files.WordEncoder(name)
    for letters in ("abHhTSs     .,!?'é÷×Éßÿ\n19|", "aHhTt   .,'é\u0331\u0308\u0301İΣσ😀漢\x01\xa0\x85<|endoftext|>"):
        for _ in range(60):
            texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(30)] + [None, "", "A<|EndOfText|>. a<|endoftext|>."][: rnd.randint(2, 3)]
            found = own.encode(pa.array(texts, pa.string()).slice(1), 2).to_pylist()
            assert found == [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[1:]]


def test_warc(spark):
    big = "é" * 60
    data = [(1, "http://b.org/x", big), (2, "http://a.org/y\r\nX: 1", big), (3, None, None), (4, "no scheme", "WARC/1.1\r\n\r\n\r\n" * 20), (5, "http://a.org/y", "s"), (6, "http://a.org/y", "s"), (None, "http://c.org", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    found = warc.archive_and_read(pages, scratch_path(spark, "w")).orderBy("part", "at").collect()
    assert [(r.url_key, r.time, r.page_id or 0) for r in found] == sorted((r.url_key, r.time, r.page_id or 0) for r in found)
    by = {r.page_id: r for r in found}
    assert len(found) == 7
    for i, _, html in data:
        payload = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, None, 5, 6)] == [("response", None), ("revisit", 1), ("revisit", 1), ("response", None), ("response", None)]
    assert warc.archive_and_read(pages.limit(0), scratch_path(spark, "w")).count() == 0


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda v: v)) == sorted(sum(runs, []))


def test_rule_statistics():
    rnd = random.Random(2)
    for _ in range(300):
        w = [rnd.choice("abc#") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))]
        t = "".join(x + rnd.choice([" ", "\n", "\n\n", "\t"]) for x in w)
        words = WORD.findall(t)
        spots = {}
        for i in range(len(words) - 7):
            spots.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n_words, chars, symbols, n_lines, dups, repeats, *_ = rule_stats(t)
        assert (n_words, chars, symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for x in words for c in x))
        assert (n_lines, dups, repeats) == (len(lines), len(lines) - len(set(lines)), len(covered))
    assert rule_stats(None) == rule_stats("") == (0,) * 8
    assert repeated_words([b"a"] * 9) == 9


def test_quality_rules(spark, docs):
    found = quality_rules.assess(docs).collect()
    assert len(found) == docs.count() and all(not r.kept for r in found if r.n_words < 20)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality_rules.assess(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.5
    assert quality_rules.accepted(docs).columns == docs.columns
    assert quality_rules.assess(docs.limit(0)).count() == 0


def test_quality_rules_by_kind(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = F.size(F.expr("filter(split(text, ' '), w -> w rlike '(###|[$]{3}|%%%|&&&|[*]{3})')"))
    pipes = F.size(F.expr("filter(split(text, ' '), w -> w = '|')"))
    kinds = d.select("doc_id", F.when(5 * pipes > F.size(F.split("text", " ")), "pipes").when(5 * marks > F.size(F.split("text", " ")), "marks").otherwise("other").alias("kind"))
    judged = quality_rules.assess(d).join(kinds, "doc_id").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").where("not base_failed").toPandas()
    gone = lambda x: 1 - x.kept.mean()
    assert gone(judged[judged.kind == "pipes"]) > 0.9 and gone(judged[judged.kind == "marks"]) > 0.9
    assert gone(judged[judged.quality == 0]) > 0.9 and gone(judged[judged.quality == 1]) < 0.01


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, []), (1100, [1.0] * 3), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = vamana.neighbours(df, df.where("vec_id % 50 = 0"), shard_rows=256).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[100:400] = s[100]
        s[q] = -9
        wanted = np.lexsort((np.arange(900), -s))[:5].tolist()
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert len(got) == 5 and all(abs(score - s[v]) < 1e-9 for _, v, score in got)
        hits += len({v for _, v, _ in got} & set(wanted))
    assert hits / 90 >= 0.9 and not [r for r in found if r.query_id >= 900]


def test_link_graph(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("bad.com", "/", "block")]
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts) + '<a href="/here">y</a>'
    data = [
        (1, "http://Good.ORG/a", link("near.net")), (2, "http://x.example.org/es/1?q#f", None), (3, "http://farm.net/", link("bad.com")), (4, "http://bad.com/z", link("farm.net")),
        (5, "http://near.net/", ""), (6, "nothing", None), (7, None, None), (8, "http://example.orgs/es/", None), (9, "ftp://org?x", None),
    ]
    found = {r.page_id: r for r in linkgraph.judge(spark.createDataFrame(data, "page_id long, url string, html string"), rules).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in found.items()} == {
        1: ("good.org", "/a", "org/"), 2: ("x.example.org", "/es/1", "example.org/es/"), 3: ("farm.net", "/", None), 4: ("bad.com", "/z", "bad.com/"), 5: ("near.net", "/", None),
        6: ("", "", None), 7: ("", "", None), 8: ("example.orgs", "/es/", None), 9: ("org", "", None),
    }
    assert {i: r.verdict for i, r in found.items()} == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    assert sum({r.host: r.host_trust for r in found.values()}.values()) == pytest.approx(1, abs=1e-3)


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, d, DIR).write.parquet(path)
        d = spark.read.parquet(path)
        assert d.columns == columns and d.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, d, DIR)
    assert last.count() == d.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_link_graph_settles(spark):
    assert all(4 * d ** linkgraph.enough_rounds(d, t) < t for d in (0.3, 0.85, 0.99) for t in (1e-3, 1e-6))
    n = 34  # each host links to the one before, the first is blocked
    data = [(i, f"http://h{i}.net/", f'<a href="http://h{i - 1}.net/">x</a>' if i else "") for i in range(n)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    with pytest.raises(RuntimeError):
        linkgraph.judge(pages, [("h0.net", "/", "block")], rounds=2)
    found = linkgraph.judge(pages, [("h0.net", "/", "block")], damping=0.5, tolerance=1e-10).collect()
    assert {r.verdict for r in found} == {"block"} and min(r.host_distrust for r in found) > 0
