"""Order-preserving bits and selection by bit prefixes."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadshape.functions.bits import from_ordered_bits, ordered_bits
from loadshape.functions.stats import grouped_quantiles, selected_quantiles
from loadshape.operators.aggregate import aggregate_basic
from loadshape.operators.curves import consumption_curve


def _doubles():
    rng = random.Random(4)
    drawn = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    edges = [0.0, -0.0, 1.0, -1.0, 2.0 ** -1022, 2.0 ** -1074, -(2.0 ** -1074), 2.0 ** -1030, 1.7976931348623157e308, math.inf, -math.inf,
             math.nextafter(1.0, 0), math.nextafter(2.0, 3), math.nextafter(2.0 ** 40, 0), 0.1, 1e-300, 12345.678]
    edges += [2.0 ** k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0 ** k, 0) for k in range(-1070, 1024, 7)]
    return [x for x in drawn if x == x] + edges


def test_bits_keep_order_and_come_back(spark):
    xs = _doubles()
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_bits(F.col("x")).alias("b"))
    rows = rows.select("x", "b", from_ordered_bits(F.col("b")).alias("y")).collect()
    for x, b, y in rows:
        assert x == y, (x, b, y)
        raw = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert abs(b) == raw and (b >= 0) == (x >= 0), x
    by_bits = [r.x for r in sorted(rows, key=lambda r: r.b)]
    assert by_bits == sorted(xs)
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(ordered_bits(F.col("x")).alias("b")).collect()
    assert [r.b for r in none] == [None, None]


@pytest.mark.parametrize("seed", range(2))
def test_selection_equals_percentile(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in (("hot", 4000), (None, 700), ("one", 1), ("ties", 500)):
        v = rng.standard_normal(n) * 10.0 ** rng.integers(-6, 6, n) if key != "ties" else rng.integers(0, 3, n).astype(float)
        rows += [(key, 1, float(x)) for x in v] + [(key, 1, None), (key, 1, float("nan"))]
    rows.append(("empty", 1, None))
    df = spark.createDataFrame(rows, "k string, j int, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: tuple(r[2:]) for r in selected_quantiles(df, ["k", "j"], "v", probs).collect()}
    want = df.where("v is not null and not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
    assert got == {r.k: tuple(r.q) for r in want}


def test_hot_groups_take_the_same_medians(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot" if k % 3 == 0 else f"h{k % 40}", start + dt.timedelta(hours=rng.randrange(24 * 60)), rng.choice([0.0, rng.random(), None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "aID string, TIDPUNKT timestamp_ntz, FORBRUKNING_KWH double")
    def table(**kw):
        found = aggregate_basic(df, "month", ["sum", "median", "q90"], True, **kw).collect()
        return sorted((*r[:4], round(r[4], 9), *r[5:]) for r in found)      # sums add up in another order

    want = table()
    assert table(strategy="grouping_sets") == want == table(single_task_max=50)
    assert table(strategy="grouping_sets", single_task_max=50) == want


def test_median_curves(spark):
    rng = random.Random(6)
    months = [dt.datetime(2024, m, 1) for m in (1, 2, 3)]
    rows = [(months[0] if k % 3 else rng.choice(months), rng.choice(["high", "low", "all"]), rng.choice([0, 1]), rng.choice([None, rng.random()])) for k in range(900)]
    df = spark.createDataFrame(rows, "TIDPUNKT timestamp_ntz, price string, tariff_active int, v double")
    split = dict(splits=["price", "tariff_active"], split_values=[["high", "low"], [0, 1]])
    for kw in ({}, {"price": "all"}, {"splits": ["price"]}, split):
        got = sorted(map(tuple, consumption_curve(df, "v", "median", single_task_max=20, **kw).collect()), key=str)
        assert got == sorted(map(tuple, consumption_curve(df, "v", "median", **kw).collect()), key=str)
    wide = {r.TIDPUNKT: r for r in consumption_curve(df, "v", "median", **split).collect()}
    for m in months:
        v = [x for t, p, a, x in rows if t == m and p == "high" and a == 1 and x is not None]
        assert wide[m]["high_1"] == pytest.approx(np.median(v))


def test_no_task_takes_a_whole_hot_group(spark):
    df = spark.range(60_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.rand(1).alias("v"))
    out = grouped_quantiles(df, ["k"], "v", [0.5], single_task_max=1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" in plan                 # the ordinary groups
    assert out.where("k = 'hot'").count() == 1 and out.count() == 40_001
