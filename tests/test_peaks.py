import datetime as dt
import random

import numpy as np
import pytest

from loadshape.operators import peaks as PK

SCHEMA = ("aID string, TIDPUNKT timestamp_ntz, price string, tariff_active int, "
          "peak1_consumption double, peak2_consumption double, peak3_consumption double, "
          "peak1_time timestamp_ntz, peak2_time timestamp_ntz, peak3_time timestamp_ntz")


def _wide(spark, n=60, seed=3, with_missing=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        m = dt.datetime(2025, 1 + i % 3, 1)
        vals = sorted((round(rnd.uniform(0, 10), 2) for _ in range(3)), reverse=True)
        times = [m + dt.timedelta(days=rnd.randint(0, 27), hours=rnd.randint(0, 23)) for _ in range(3)]
        if with_missing and i % 7 == 0:
            vals[2], times[2] = None, None
        if with_missing and i % 11 == 0:
            times[1] = None                     # time missing, value present -> pair dropped
        rows.append((f"h{i}", m, "high", i % 2, *vals, *times))
    return spark.createDataFrame(rows, SCHEMA)


def test_peaks_long_drops_incomplete_pairs(spark):
    df = _wide(spark)
    rows = df.collect()
    expected = sum(1 for r in rows for i in (1, 2, 3)
                   if r[f"peak{i}_time"] is not None and r[f"peak{i}_consumption"] is not None)
    assert PK.peaks_long(df).count() == expected


def test_hour_distribution_and_heatmaps(spark):
    df = _wide(spark)
    long = PK.peaks_long(df).collect()
    by_hour = {}
    for r in long:
        by_hour[r.peak_time.hour] = by_hour.get(r.peak_time.hour, 0) + 1
    got = {r.hour: r.n_peaks for r in PK.peak_hour_distribution(df, "count").collect()}
    assert got == by_hour
    heat = PK.peak_heatmap(df, "count").collect()
    assert len(heat) == 3 * 24 and sum(r.value for r in heat) == len(long)
    tar = PK.tariff_peak_heatmap(df, "consumption").collect()
    for r in tar:
        assert r.diff == pytest.approx(r.after - r.before)
    assert sum(r.before + r.after for r in tar) == pytest.approx(sum(r.peak_consumption for r in long))
    vmax = PK.tariff_peak_max(PK.tariff_peak_heatmap(df, "count")).first().vmax
    cnt = PK.tariff_peak_heatmap(df, "count").collect()
    assert vmax == max(max(r.before, r.after) for r in cnt)
    with pytest.raises(ValueError):
        PK.peak_heatmap(df, "sum")


@pytest.mark.parametrize("seed,const", [(1, False), (2, False), (3, True)])
def test_histogram_matches_numpy(spark, seed, const):
    df = _wide(spark, n=80, seed=seed)
    if const:
        from pyspark.sql import functions as F
        df = df.select(*[F.lit(4.2).alias(c) if c.endswith("consumption") else F.col(c) for c in df.columns])
    vals = [v for r in df.collect() for v in (r.peak1_consumption, r.peak2_consumption, r.peak3_consumption)
            if v is not None]
    counts, edges = np.histogram(vals, bins=30)
    got = PK.peak_histogram(df).orderBy("bin").collect()
    assert [r.n for r in got] == counts.tolist()
    assert [r.bin_start for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1].bin_end == pytest.approx(edges[-1])


def test_rank_box_matches_numpy(spark):
    df = _wide(spark, n=90, seed=9, with_missing=False)
    got = {r.rank: r for r in PK.peak_rank_box(df).collect()}
    rows = df.collect()
    for i in (1, 2, 3):
        x = np.array([r[f"peak{i}_consumption"] for r in rows])
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        iqr = q3 - q1
        inside = x[(x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)]
        g = got[i]
        assert (g.q1, g.median, g.q3) == pytest.approx((q1, med, q3))
        assert g.whisker_low == pytest.approx(inside.min()) and g.whisker_high == pytest.approx(inside.max())
        assert g.n_outliers == len(x) - len(inside) and g.n == len(x)
