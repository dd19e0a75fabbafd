"""Property checks on arbitrary small inputs (ties, missing values, single
readings): price parts partition 'all', peaks are ordered, the strategies
agree, exact quantiles equal numpy's."""

import datetime as dt
import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loadshape import schemas as S
from loadshape.functions.stats import exact_quantiles
from loadshape.operators import aggregate as A

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

reading = st.tuples(
    st.sampled_from(["a", "b"]),
    st.integers(min_value=0, max_value=20 * 24 - 1),          # hour offset in 20 winter days
    st.one_of(st.none(), st.sampled_from([0.0, 1.5, 2.25, 3.0]), st.floats(0, 50).map(lambda x: round(x, 2))),
)


def _frame(spark, rows):
    base = dt.datetime(2025, 1, 1)
    data = [(i, base + dt.timedelta(hours=h), (base + dt.timedelta(hours=h)).date(), v) for i, h, v in rows]
    return spark.createDataFrame(data, S.METER_SCHEMA)


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9,
                                                                                         abs_tol=1e-9))


@SETTINGS
@given(st.lists(reading, min_size=1, max_size=60))
def test_parts_partition_and_strategies_agree(spark, rows):
    m = _frame(spark, rows)
    methods = ["sum", "mean", "variance", "max", "median", "top3_mean"]
    auto = {(r.aID, r.period, r.price): r for r in A.aggregate(m, "week", methods, True).collect()}
    raw = {(r.aID, r.period, r.price): r for r in A.aggregate(m, "week", methods, True, strategy="explode").collect()}
    assert auto.keys() == raw.keys()
    for k, r in auto.items():
        for c in ("sum_consumption", "mean_consumption", "variance_consumption", "max_consumption",
                  "median_consumption", "top3_mean_consumption"):
            assert _close(r[c], raw[k][c]), (k, c)
        peaks = [p for p in (r.peak1_consumption, r.peak2_consumption, r.peak3_consumption) if p is not None]
        assert peaks == sorted(peaks, reverse=True)
        if k[2] == "all":
            parts = [auto.get((k[0], k[1], p)) for p in ("high", "low")]
            assert math.isclose(r.sum_consumption, sum(p.sum_consumption for p in parts if p), abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=80),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_equal_numpy(spark, values, probs):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.q_index: r.quantile for r in
           exact_quantiles(df, "v", probs, partitions=3, single_task_max=None).collect()}
    want = np.quantile(np.array(values), probs)
    for i, w in enumerate(want):
        assert math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9)
