"""WARC archives, link graphs and nearest neighbours against plain versions."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linkgraph, mixing, vamana, warc
from tessera.llm.common import scratch_path


def as_contract(data, least=100):
    first = {}
    for i, _, html in data:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in data:
        p = (html or "").encode()
        f = first.get(html or "")
        again = len(p) >= least and f is not None and i != f
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_archives(spark, monkeypatch):
    rnd = random.Random(4)
    hot, big = "<p>not found</p>" * 20, "é" * 1_500_000  # half of all pages have one payload; pages of 3 MB
    data = [(i, f"http://h{i % 5}.org/{i % 7}", hot if i % 2 else f"<p>{i}</p>" * rnd.choice([1, 30, 9000])) for i in range(240)]
    data += [(300, "http://a.org/big", big), (301, "http://a.org/big", big), (302, "http://a.org/other", big[:-1]), (2, "http://z.org/", hot), (1, "http://y.org/", hot), (1, "http://y.org/", hot)]
    data += [(None, "http://n.org/", hot), (None, None, "x" * 200), (None, "u", "x" * 200), (400, "http://r\r\n.org", None), (401, None, "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "refers_to": F.lit(2)})
    zone, path = spark.conf.get("spark.sql.session.timeZone"), scratch_path(spark, "w")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        warc.write(pages, path, archive_bytes=1 << 20)
        rows = warc.read_runs(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == as_contract(data)
    assert {r.time for r in rows if r.page_id == 0} == {"2020-01-01T00:00:00Z"} and {r.time for r in rows if r.page_id == 61} == {"2020-01-01T00:01:01Z"}
    archives = {}
    for r in rows:
        archives.setdefault(r.archive, []).append(r.length)
    assert all(sum(sizes) < 2 << 20 or len(sizes) == 1 for sizes in archives.values())
    runs = spark.createDataFrame(rows, warc.CAPTURE)
    merged = warc.merge_runs(runs, captures=40).orderBy("part", "at").collect()
    key = [(r.url_key, r.time, r.page_id is not None, r.page_id or 0) for r in merged]
    assert key == sorted(key) and len(merged) == len(data) and len({r.part for r in merged}) > 3
    plan = warc.deduplicated(pages)[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(payload_digest" not in plan  # bodies are never dealt out by digest alone
    assert os.path.isdir(path.removeprefix("file:"))


def ranks(links, seeds, damping):
    """Personalised PageRank by plain iteration: what has no way on returns to the seeds."""
    hosts = sorted({h for e in links for h in e[:2]} | set(seeds))
    total = {h: sum(n for s, _, n in links if s == h) for h in hosts}
    now = dict(seeds)
    for _ in range(400):
        lost = sum(now.get(h, 0) for h in hosts if not total[h])
        new = {h: (1 - damping + damping * lost) * seeds.get(h, 0) for h in hosts}
        for s, d, n in links:
            new[d] += damping * now.get(s, 0) * n / total[s]
        now = new
    return now


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_and_rules(spark, seed):
    rnd = random.Random(seed)
    hosts = [f"h{i}.{rnd.choice(['org', 'com', 'net'])}" for i in range(25)]
    rules = [("org", "/", "allow"), ("com", "/de", "block"), ("com", "/de/ok", "allow"), ("h3.net", "", "block"), ("net", "/x", "allow"), ("net", "/x", "block")]
    data = []
    for i in range(160):
        to = rnd.sample(hosts, rnd.randint(0, 4))
        data.append((i, f"https://{rnd.choice(hosts).upper()}{rnd.choice(['/', '/de', '/de/okay', '/x?y', '', '/fr#de'])}", " ".join(f"<a href='//{h}/'>" for h in to)))
    data += [(None, "http://h1.org/", ""), (5, None, None), (5, "http://h1.org/", "<a href=http://H2.ORG/>"), (5, "http://h1.org/", "<a href=http://H2.ORG/>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash"), "trust": F.lit(0)})
    found = linkgraph.judge(pages, rules, tolerance=1e-10).collect()
    by_table = linkgraph.judge(pages, rules, tolerance=1e-10, max_rules=2).collect()
    plainly = lambda rs: sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict, round(r.host_trust, 7), round(r.host_distrust, 7)) for r in rs)
    assert plainly(found) == plainly(by_table) and len(found) == len(data)
    counts, links = {}, {}
    for _, url, html in data:
        rest = (url or "").partition("://")[2]
        host, path = rest.split("/")[0].split("?")[0].split("#")[0].lower(), ""
        if "/" in rest:
            path = "/" + rest.partition("/")[2].split("?")[0].split("#")[0]
        fits = [(len(h + p), len(h), -n, v) for n, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict = max(fits)[3] if fits else None
        if host:
            counts.setdefault(host, []).append(verdict)
        for part in (html or "").split("//")[1:]:
            to = part.split("/")[0].lower()
            if host and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    share = lambda v: {h: c.count(v) / max(1, sum(x.count(v) for x in counts.values())) for h, c in counts.items()}
    edges = [(s, d, n) for (s, d), n in links.items()]
    trust, distrust = ranks(edges, share("allow"), 0.85), ranks([(d, s, n) for s, d, n in edges], share("block"), 0.85)
    for r in found:
        if r.host:
            assert (r.host_trust, r.host_distrust) == (pytest.approx(trust[r.host], abs=1e-6), pytest.approx(distrust[r.host], abs=1e-6))
            if r.rule is None:
                assert r.verdict == ("block" if distrust[r.host] > trust[r.host] else "allow") or abs(distrust[r.host] - trust[r.host]) < 1e-8
    assert linkgraph.judge(pages.limit(0), rules).count() == 0 and linkgraph.judge(pages.limit(0), rules, max_rules=1).count() == 0


def nearest(data, q, k=5):
    """The contract by brute force: (vec_id, score), best first, ties to the smaller id."""
    x = np.array(data[q], float)
    scored = []
    for i, v in data.items():
        if i != q:
            a, b = x / np.abs(x).max(), np.array(v, float) / np.abs(v).max()
            scored.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("kind", ["orthogonal", "quantised", "multiples"])
def test_ties_go_to_the_smaller_id(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "orthogonal":
        data = {i: np.eye(16)[i].tolist() for i in range(16)}
    elif kind == "quantised":
        x = rng.integers(-1, 2, (600, 4))
        data = {i: v.tolist() for i, v in enumerate(x.astype(float)) if v.any()}
    else:  # hundreds of lengths of a few directions
        x = rng.normal(size=(4, 8))
        data = {i: (x[i % 4] * 2.0 ** rng.integers(-20, 20)).tolist() for i in range(900)}
    ids = list(data)
    rng.shuffle(ids)
    df = spark.createDataFrame([(int(i), data[i]) for i in ids], "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "dim": F.lit(2), "key": F.lit(3)})
    found = vamana.neighbours(df, df.where("vec_id % 50 = 0"), shard_rows=200).collect()
    for q in (i for i in data if i % 50 == 0):
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        wanted = nearest(data, q)
        assert [g[1] for g in got] == [w[0] for w in wanted]
        assert all(abs(g[2] - w[1]) < 1e-9 for g, w in zip(got, wanted))
    assert vamana.neighbours(df.limit(0), df.limit(0)).count() == 0 and vamana.neighbours(df, df.limit(0)).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """Targets by repeated sharing: a source above its cap stops there, the rest is shared anew."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    fixed, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [n for n in names if n not in fixed]
        share = {n: (left - sum(fixed.values())) * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > cap * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: cap * sizes[n] for n in over}


def test_mix_targets(spark):
    rnd = random.Random(6)
    for _ in range(3):
        sizes = {rnd.choice("aäbBzé漢") + str(i): rnd.choice([0, 1, 5, 300, 4000]) for i in range(rnd.randint(2, 8))} | {None: 50}
        data = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())] + [(99, None, None), (99, "", "a0")]
        sizes.setdefault("a0", 0)
        df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "target": F.lit(2), "shard": F.lit(3)})
        wanted = plain_targets(sizes)
        found = mixing.mix(df).collect()
        assert len(found) == len(data)
        taken = {}
        for r in found:
            names = [s for i, t, s in data if i == r.doc_id and len((t or "").split()) == r.size]
            assert any(abs(wanted[s] - r.target) < 1e-6 and sizes[s] == r.source_size for s in names)
            taken[r.target] = taken.get(r.target, 0) + r.taken
        assert all(abs(t - n) <= 16 * len(sizes) for t, n in taken.items())
    long = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "few words", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.mix(long).collect()} == {1: 300_000, 2: 2}
