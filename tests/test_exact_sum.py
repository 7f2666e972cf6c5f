"""Sums of doubles against fractions, in any order."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from countercheck.functions import exact_sum
from countercheck.operators.aggregates import Metric, aggregate_compare


def summed(df):
    x = F.col("x")
    parts = df.select("g", x["band"].alias("band"), x["part"].alias("part")).filter("band is not null")
    bands = parts.groupBy("g", "band").agg(exact_sum.total_of(F.col("part")).alias("total"))
    lists = bands.groupBy("g").agg(F.collect_list(F.struct("band", "total")).alias("t"))
    return {r[0]: r[1] for r in lists.select("g", exact_sum.joined(F.col("t"))).collect()}


def test_sums_as_of_fractions(spark):
    rnd = random.Random(12)
    groups = [
        [1e308, 1e308, -1e308, -1e308, 5e-324, 1.0],
        [0.1] * 10,
        [2.0**k * s for k in range(-1074, 1024) for s in (1, -1)] + [2.0**-1074],
        [math.nextafter(2.0**k, math.inf) for k in range(-1000, 1000, 7)] + [-math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 7)],
        [5e-324] * 3 + [-0.0, 0.0],
        [1e16, 1.0, -1e16],
        [-1.0, 2.0**-60],
    ]
    for _ in range(30):
        groups.append([rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.randint(-60, 60) for _ in range(rnd.randint(1, 80))])
    rows = [(i, x) for i, g in enumerate(groups) for x in g]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v double").select("g", exact_sum.band_of(F.col("v")).alias("x"))
    assert summed(df) == {i: float(sum(map(Fraction, g))) for i, g in enumerate(groups)}
    parts = df.select("x.*").collect()
    assert all(abs(r["part"]) < 2**62 for r in parts)


def test_no_finite_sum(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, inf), (0, 1.0), (1, -inf), (2, inf), (2, -inf), (3, 1e308), (3, 1e308), (4, nan), (4, None), (4, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double").select("g", exact_sum.band_of(F.col("v")).alias("x"))
    got = summed(df)
    assert got[0] == inf and got[1] == -inf and math.isnan(got[2]) and got[3] == inf and got[4] == 2.0
    assert exact_sum.join(None) is None and exact_sum.join([]) is None


def test_comparison_is_exact(spark):
    rnd = random.Random(3)
    rows = [(i % 3, rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 12), rnd.random()) for i in range(3000)]
    schema = "g int, v double, f float"
    source = spark.createDataFrame([*rows, (7, None, None)], schema)
    rnd.shuffle(rows)
    target = spark.createDataFrame([(7, None, None), *rows], schema).repartition(5)
    metrics = [Metric(c, f) for c in "vf" for f in ("SUM", "AVG", "MIN", "MAX", "COUNT", "COUNT_DISTINCT")]
    for by in ([], ["g"]):
        out = aggregate_compare(source, target, metrics, by).collect()
        assert len(out) == 12 * (4 if by else 1)
        assert {(r["difference"], r["status"]) for r in out} == {(0.0, "PASS")}
    total = aggregate_compare(source, target, [Metric("v", "SUM")]).first()["source_value"]
    assert total == float(sum(Fraction(r[1]) for r in rows))
    one = spark.createDataFrame([(1e12,)], "v double")
    two = spark.createDataFrame([(1e12 + 100,)], "v double")
    assert tuple(aggregate_compare(one, two, [Metric("v", "SUM")]).select("difference", "status").first()) == (100.0, "FAIL")
    none = aggregate_compare(one.limit(0), one, [Metric("v", "SUM"), Metric("v", "COUNT")]).orderBy("metric").collect()
    assert [(r["source_value"], r["target_value"]) for r in none] == [(0.0, 1.0), (0.0, 1e12)]
