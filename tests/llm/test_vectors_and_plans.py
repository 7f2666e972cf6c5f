"""Neighbours, forest, sharding, mixing and URL lists against brute force, with odd inputs."""

import datetime as dt
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from countercheck.llm import forest, mixing, neighbours, queries, shards, urls

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def clusters(seed=1):
    """Random vectors, near copies around some of them, copies, and vectors without a direction."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16)) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1] + 0.02 * rng.standard_normal(16)) for i in range(90)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)]
    out = [(i, [float(np.float32(x)) for x in v], i % 2 if i < 1000 else 1, 0.0) for i, v in rows]
    odd = [(None, [1.0] * 16, 1, 0.0), (3001, None, 1, 0.0), (3002, [0.0] * 16, 1, 0.0), (3003, [1.0, None] * 8, 1, 0.0)]
    odd += [(3004, [float("nan")] * 16, 1, 0.0), (3005, [1.0] * 3, 1, 0.0), (3006, [1.0] * 16, None, 0.0), (3007, [], 0, 0.0)]
    return out, odd


def brute_nearest(known, asked, k=5):
    want = {}
    for q in asked:
        same = [i for i, v in known.items() if i != q and len(v) == len(known[q])]
        scored = [(-float(neighbours.cosine(known[q], known[i][None])[0]), i) for i in same]
        want[q] = [i for _, i in sorted(scored)[:k]]
    return want


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_is_exact_with_all_buckets_and_near_with_few(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    good, odd = clusters()
    df = spark.createDataFrame(good + odd, VECTORS)
    known = {r[0]: np.array(r[1], np.float64) for r in good} | {3005: np.ones(3), 3006: np.ones(16)}
    asked = df.filter("vec_id % 20 = 0")
    want = brute_nearest(known, [k for k in known if k % 20 == 0])
    for probes, least in ((1024, 1.0), (None, 0.9)):
        got = {q: [] for q in want}
        for r in sorted(neighbours.nearest(df, asked, probes=probes).collect()):
            got[r["query_id"]].append(r["vec_id"])
        hits = sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want))
        assert hits >= least
        if least == 1.0:
            assert got == want
    assert neighbours.nearest(df.limit(0), asked).count() == 0 and neighbours.nearest(df, asked.limit(0)).count() == 0


def test_nearest_by_length_and_with_extreme_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(5 if i % 3 else 9) * 10.0 ** rng.choice([-170, 0, 170])).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:7], "vec_id long, embedding array<double>")
    want = brute_nearest({i: np.array(v) for i, v in rows}, range(60))
    got = {}
    for r in sorted(neighbours.nearest(df, df, probes=2048).collect()):
        assert -1 - 1e-12 <= r["score"] <= 1 + 1e-12
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want


def test_nearest_looks_at_less_the_more_vectors_there_are():
    shares = [neighbours.probes_for(n, 64, 5, 10) * 10 / 128**2 for n in (10**3, 10**4, 10**5, 10**6, 10**8)]
    assert shares == sorted(shares, reverse=True) and shares[2] < 0.1 and shares[-1] < 0.04
    assert neighbours.probes_for(5, 64, 5, 10) > 4000 and neighbours.probes_for(3, 1, 5, 10) <= 4


def test_recall_and_share_on_vectors_without_structure():
    """With production parameters, by the operator's own buckets: 20,000 vectors, 50 queries."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((20_000, 64))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit[:50] @ unit.T
    near[np.arange(50), np.arange(50)] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    count = neighbours.probes_for(20_000, 64, 5, neighbours.TABLES)
    met = np.zeros((50, 20_000), bool)
    for t in range(neighbours.TABLES):
        one, two = neighbours._axes(rows, t, neighbours.SEED)
        bucket = one.argmax(axis=1) * 128 + two.argmax(axis=1)
        wanted = neighbours._best_pairs(one[:50], two[:50], count)
        sums = (one[:50, :, None] + two[:50, None, :]).reshape(50, -1)
        assert np.allclose(np.sort(np.take_along_axis(sums, wanted, 1)), np.sort(sums)[:, -count:])
        for q in range(50):
            met[q] |= np.isin(bucket, wanted[q])
    assert np.take_along_axis(met, best, 1).mean() >= 0.9 and met.mean() < 0.18


@pytest.mark.parametrize("block", [2048, 16])
def test_forest(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    good, odd = clusters()
    out = forest.near_duplicates(spark.createDataFrame(good + odd, VECTORS), leaf=100).collect()
    unit = np.array([r[1] for r in good], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    reach = linked | np.eye(len(good), dtype=bool)
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([r[0] for r in good])
    want = {int(k): (int(linked[i].sum()), int(ids[reach[i]].min())) for i, k in enumerate(ids)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert len(out) == len(good) + len(odd)
    assert {k: got[k] for k in want} == want and max(n for n, _ in want.values()) > 29
    assert all(got[r[0]] == (0, r[0]) for r in odd)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert forest.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_forest_leaves_stay_bounded_and_planted_pairs_are_found(spark, monkeypatch):
    """A sample that is far too small for the table, so that leaves are split again below it."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((5000, 16))
    near = base[:300] + rng.standard_normal((300, 16)) * 0.1  # cosines around 0.995
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(np.concatenate([base, near]))]
    seen = []
    plain = forest.refined

    def watched(routed, *rest):
        out = plain(routed, *rest)
        seen.append([max(r["count"] for r in f.selectExpr("explode(leaves) leaf").groupBy("leaf").count().collect()) for f in (routed, out)])
        assert out.count() == routed.count()
        return out

    monkeypatch.setattr(forest, "refined", watched)
    out = forest.near_duplicates(spark.createDataFrame(rows, VECTORS), sample=256, leaf=300).collect()
    before, after = seen[0]
    assert before > 600 >= after
    got = {r["vec_id"]: r for r in out}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    assert want.sum() > 500 and all(got[i]["n_links"] <= n for i, n in enumerate(want))
    assert sum(r["n_links"] for r in out) >= 0.98 * want.sum()


def test_rebalance_and_grow():
    rng = np.random.default_rng(2)
    loads = rng.integers(0, 1000, 600)
    loads[0] = 9000
    start = np.arange(600) % 8
    even = shards.rebalance(loads, start, 8)
    held = np.bincount(even, weights=loads, minlength=8)
    assert held.max() - held.min() <= 0.002 * held.mean()
    more = shards.grow(loads, even, 9)
    assert set(more[more != even]) == {8} and np.bincount(more, weights=loads, minlength=9)[8] > 0.8 * loads.sum() / 9
    assert (shards.rebalance(np.zeros(10, np.int64), np.arange(10) % 3, 3) == np.arange(10) % 3).all()


def test_shards(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 900), "s") for i in range(500)] + [(None, None, "s"), (7, "é", "s"), (7, "é", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = str(tmp_path / "map")
    out = shards.assign(df, ["doc_id"], shards=6, slots=512, path=path)
    got = out.collect()
    assert len(got) == len(rows)
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert max(held.values()) < 1.02 * min(held.values()) and len(held) == 6
    for shard in held:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert [r["size"] for r in got if r["doc_id"] is None] == [8] and Counter(r["size"] for r in got if r["doc_id"] == 7)[10] == 2
    again = {tuple(r) for r in shards.assign(df, ["doc_id"], shards=6, slots=512, path=path).collect()}
    assert again == {tuple(r) for r in got}  # an even map is left alone
    shards.assign(df, ["doc_id"], shards=7, slots=512, path=path)
    assert shards.SlotMap(spark, path).latest()[0] == 2
    assert shards.assign(df.limit(0), ["doc_id"], slots=16).count() == 0


def test_fit_meets_the_budget():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 400, 40))
        counts = rng.integers(1, 50, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert 0 <= budget - int((sizes * taken).sum()) <= 1
    assert mixing.fit(np.array([10]), np.array([3]), 25).tolist() == [2]
    large = mixing.fit(np.array([3, 200_000]), np.array([5, 9]), 1_000_006)
    assert int((large * [3, 200_000]).sum()) == 1_000_006


def test_mix(spark):
    rng = np.random.default_rng(4)
    sources = ["a"] * 600 + ["b"] * 60 + ["c"] * 300 + [None] * 40 + [""] * 30
    rows = [(i, s, " ".join(["w"] * int(rng.integers(0, 60)))) for i, s in enumerate(sources)]
    rows += [(9000, "b", None), (9001, "zero", " \n"), (None, "a", "one two"), (None, "a", "one two")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("taken", F.lit("x"))
    out = mixing.mix(df, ["doc_id"]).collect()
    total = Counter()
    for _, s, t in rows:
        total[s] += len((t or "").split())
    order = ["", "a", "b", "c", "zero", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    source = {r[0]: r[1] for r in rows}
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == total[s]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, mixing.mix(df.repartition(5), ["doc_id"]).collect())) == sorted(map(str, out))
    copies = mixing.take(df, ["doc_id"])
    assert copies.columns == df.columns
    assert sum(len(r["text"].split()) for r in copies.collect()) == sum(taken.values())
    assert mixing.mix(df.limit(0), ["doc_id"]).count() == 0


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_urls(spark):
    entries = [
        ("block", "domain", "Example.org", day(10), "add"), ("block", "domain", "example.org", day(20), "remove"),
        ("block", "domain", "example.org", day(30), "add"), ("allow", "host", "www.example.org", day(12), "add"),
        ("block", "prefix", "www.example.org/a/b", day(0), "add"), ("allow", "domain", "org", day(31), "add"),
        ("block", "host", "x.net", day(5), "add"), ("block", "host", "x.net", day(5), "remove"),
        ("block", "host", None, day(5), "add"), ("block", "other", "x.net", day(5), "add"), ("block", "host", "y.net", None, "add"),
    ]
    entries = spark.createDataFrame(entries, "list string, kind string, key string, day date, action string")
    cases = [
        ("http://a.example.org/x", 9, "none"), ("http://a.example.org/x", 10, "block"), ("http://a.example.org/x", 20, "none"),
        ("HTTPS://u@WWW.Example.ORG.:80/q", 13, "allow"), ("http://www.example.org/a/b/c?d", 13, "block"),
        ("http://www.example.org//a//b", 13, "block"), ("http://www.example.org/a/bc", 13, "allow"),
        ("http://notexample.org/", 40, "allow"), ("http://a.example.org/", 40, "block"), ("http://x.net/", 6, "none"),
        ("http://y.net", 9, "none"), (None, 12, "none"), ("no url", 12, "none"), ("http://a.example.org/", None, "none"),
    ]
    rows = [(i, u, None if d is None else day(d), "clash") for i, (u, d, _) in enumerate(cases)]
    df = spark.createDataFrame([*rows, rows[1]], "page_id long, url string, day date, decision string")
    out = urls.filter_urls(df, entries)
    assert {r["page_id"]: r["decision"] for r in out.collect()} == {i: c[2] for i, c in enumerate(cases)}
    assert out.count() == len(rows) + 1 and urls.filter_urls(df.limit(0), entries).count() == 0
    assert {r["decision"] for r in urls.filter_urls(df, entries.limit(0)).collect()} == {"none"}


def test_url_prefixes_keep_the_case_of_paths(spark):
    rows = [(i, u, "2024-02-01") for i, u in enumerate(["http://Example.com/Wiki/A", "http://example.com/wiki/A", "http://example.com/"])]
    df = spark.createDataFrame(rows, "id long, url string, day string")
    entries = spark.createDataFrame([("block", "prefix", "EXAMPLE.com/Wiki", "2024-01-01", "add")], "list string, kind string, key string, day string, action string")
    got = {r["id"]: (r["decision"], r["entry_key"]) for r in urls.filter_urls(df, entries).collect()}
    assert got == {0: ("block", "example.com/Wiki"), 1: ("none", None), 2: ("none", None)}


def test_url_query_and_sql_agree_on_cases(spark, tmp_path):
    hosts = ["Example.com", "example.com", "a.B.org", "c.net"]
    urls_ = [f"http://{h}/{s}/{t}" for h in hosts for s in ("Wiki", "wiki", "WIKI", "x") for t in range(12)]
    spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.op2_urls(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "day", "valid_from", "valid_to", "decision", "entry_kind", "entry_key"]
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP2_SQL})").fetchall())
    assert any(r[6] == "prefix" and r[7].endswith(("/Wiki", "/WIKI")) for r in got)
