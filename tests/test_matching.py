import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from study_values import d
from loadshape.operators import balance as BL
from loadshape.operators import matching as MT
from loadshape.operators import profiles as PR

SCHEMA = "aID string, TIDPUNKT timestamp_ntz, price string, tariff_active int, tariff_start date, " \
         "top3_mean_consumption double"


def _month(i):
    return dt.datetime(2024 + (i // 12), 1 + i % 12, 1)


def _agg(spark, households):
    """households: {id: (adoption date or None, [monthly values from 2024-01], skip months)}"""
    rows = []
    for hid, (adopt, values, skip) in households.items():
        for i, v in enumerate(values):
            if i in skip:
                continue
            m = _month(i)
            active = int(adopt is not None and m.date() >= adopt)
            rows.append((hid, m, "all", active, adopt, v))
            rows.append((hid, m, "high", active, adopt, v + 100.0))   # other price parts ignored
    return spark.createDataFrame(rows, SCHEMA)


def test_profiles_completeness_and_summary(spark):
    vals = [float(i) for i in range(15)]
    agg = _agg(spark, {"t": (d("2025-01-01"), vals, set()), "gap": (d("2025-01-01"), vals, {5})})
    prof = {r.id: r for r in PR.build_profiles(agg, feature_mode="time_series").collect()}
    assert set(prof) == {"t"}                       # 11 of 12 months -> dropped
    assert [prof["t"][f"peak_{i}"] for i in range(1, 13)] == vals[:12]
    s = PR.build_profiles(agg, feature_mode="summary").where("id = 't'").first()
    assert s.peak_mean == pytest.approx(5.5) and s.peak_volatility == pytest.approx(1.0)
    assert s.peak_sd == pytest.approx(np.std(vals[:12], ddof=1))
    with pytest.raises(ValueError):
        PR.build_profiles(agg, feature_mode="pca")


def test_risk_set_membership(spark):
    vals = [1.0] * 20
    agg = _agg(spark, {"t": (d("2025-01-01"), vals, set()), "same": (d("2025-01-01"), vals, set()),
                       "later": (d("2025-03-01"), vals, set()), "never": (None, vals, set())})
    rs = {(r.adoption_month, r.control_id) for r in MT.risk_set(PR.clean(agg)).collect()}
    assert (d("2025-01-01"), "later") in rs and (d("2025-01-01"), "never") in rs
    assert (d("2025-01-01"), "same") not in rs and (d("2025-01-01"), "t") not in rs
    assert (d("2025-03-01"), "later") not in rs and (d("2025-03-01"), "t") not in rs


def test_k_cut_ties_and_constant_feature(spark):
    base = [1.0] * 12 + [0.0] * 3
    hh = {"t": (d("2025-01-01"), [2.0] + base[1:], set()),
          "c2": (None, [3.0] + base[1:], set()), "c1": (None, [1.0] + base[1:], set())}
    m = MT.risk_set_matching(_agg(spark, hh), k_neighbors=5).orderBy("distance", "control_id").collect()
    assert len(m) == 2                                # only two controls
    assert [r.control_id for r in m] == ["c1", "c2"]  # equal distances -> control id order
    assert m[0].distance == pytest.approx(m[1].distance)
    assert m[0].id == "c1" and m[0].peak_1 == 1.0     # unscaled control features
    assert m[0].treated_id == "t" and m[0].adoption_month == d("2025-01-01")


def _brute(treated, controls, k):
    out = {}
    for ti, (tid, tx) in treated:
        cs = [(cid, cx) for cti, (cid, cx) in controls if cti == ti and cid != tid]
        x = np.array([c[1] for c in cs])
        mu, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
        z = lambda v: np.where(sd > 0, (v - mu) / np.where(sd > 0, sd, 1), 0.0)
        dist = sorted((float(np.sqrt(((z(cx) - z(np.array(tx))) ** 2).sum())), cid) for cid, cx in cs)
        out[(ti, tid)] = dist[:min(k, len(cs))]
    return out


@pytest.mark.parametrize("dims,seed", [(3, 1), (12, 2)])
def test_knn_is_exact(spark, dims, seed):
    rnd = random.Random(seed)
    feats = [f"f{i}" for i in range(dims)]
    treated, controls = [], []
    for ti in (d("2025-01-01"), d("2025-02-01")):
        for c in range(300):
            level = rnd.gauss(0, 3)
            controls.append((ti, (f"c{c}", [level + rnd.gauss(0, 1) for _ in feats])))
        for t in range(25):
            level = rnd.gauss(0, 6)
            treated.append((ti, (f"t{t}", [level + rnd.gauss(0, 1) for _ in feats])))
    feats[-1:] = feats[-1:]
    tdf = spark.createDataFrame([(ti, tid, *x) for ti, (tid, x) in treated],
                                "Ti date, treated_id string, " + ", ".join(f"{f} double" for f in feats))
    cdf = spark.createDataFrame([(ti, cid, *x) for ti, (cid, x) in controls],
                                "Ti date, control_id string, " + ", ".join(f"{f} double" for f in feats))
    got = {}
    for r in MT.knn_edges(tdf, cdf, feats, 5, per_cell=4).collect():
        got.setdefault((r.Ti, r.treated_id), []).append((r.neighbor, r.distance, r.control_id))
    want = _brute(treated, controls, 5)
    assert got.keys() == want.keys()
    for key, edges in got.items():
        edges.sort()
        assert [c for _, _, c in edges] == [c for _, c in want[key]], key
        assert [dist for _, dist, _ in edges] == pytest.approx([dist for dist, _ in want[key]], rel=1e-9)


def test_balance_control_profile_modes(spark):
    base = list(range(14))
    hh = {"t1": (d("2025-01-01"), [float(x) for x in base], set()),
          "t2": (d("2025-01-01"), [float(x) + 0.5 for x in base], set()),
          "late": (d("2025-02-01"), [float(x) + 0.2 for x in base], set()),
          "never": (None, [float(x) + 0.1 for x in base], set())}
    agg = _agg(spark, hh)
    matches = MT.risk_set_matching(agg, k_neighbors=2, feature_mode="summary")
    # t1, t2 (Jan) match late + never; late itself is treated in Feb and matches never
    assert sorted((r.treated_id, r.control_id) for r in matches.collect()) == [
        ("late", "never"), ("t1", "late"), ("t1", "never"), ("t2", "late"), ("t2", "never")]
    prof = PR.build_profiles(agg, feature_mode="summary")
    own = {r.covariate: r for r in BL.balance_table(prof, matches).collect()}
    at = {r.covariate: r for r in BL.balance_table(prof, matches, "at_match").collect()}
    # 'never' has no own profile: only 'late' (twice) enters the own-adoption control mean
    late_mean = np.mean([x + 0.2 for x in base[1:13]])
    assert own["peak_mean"].control_mean == pytest.approx(late_mean)
    assert at["peak_mean"].control_mean != pytest.approx(late_mean)
    love = BL.love_table(BL.balance_table(prof, matches)).collect()
    smds = [r.abs_smd for r in love if r.abs_smd is not None]   # zero pooled variance -> NULL
    assert smds == sorted(smds, reverse=True)
    assert [r.abs_smd for r in love][:len(smds)] == smds          # NULLs sort last
    with pytest.raises(ValueError, match="empty"):
        BL.balance_table(prof, matches.where(F.lit(False)))


def test_identical_controls_are_reduced_exactly(spark):
    feats = ["f0", "f1", "f2"]
    ti = d("2025-01-01")
    controls = [(ti, f"z{i:03d}", 0.0, 0.0, 0.0) for i in range(200)]          # 200 identical profiles
    controls += [(ti, f"c{i}", float(i % 7), float(i % 5), float(i % 3)) for i in range(40)]
    treated = [(ti, "t0", 0.1, 0.0, 0.0), (ti, "t1", 6.0, 4.0, 2.0)]
    cdf = spark.createDataFrame(controls, "Ti date, control_id string, f0 double, f1 double, f2 double")
    tdf = spark.createDataFrame(treated, "Ti date, treated_id string, f0 double, f1 double, f2 double")
    got = {}
    for r in MT.knn_edges(tdf, cdf, feats, 3).collect():
        got.setdefault(r.treated_id, []).append((r.neighbor, r.control_id, r.distance))
    want = _brute([(ti, (t[1], list(t[2:]))) for t in treated],
                  [(ti, (c[1], list(c[2:]))) for c in controls], 3)
    for tid, edges in got.items():
        edges.sort()
        assert [c for _, c, _ in edges] == [c for _, c in want[(ti, tid)]]
    assert [c for _, c, _ in sorted(got["t0"])] == ["c0", "z000", "z001"]   # c0 is all-zero too


def test_collapse_split_month(spark, meter_df, tariff_df):
    from loadshape.plans.pipeline import run
    rows = []
    for day, v in ((3, 5.0), (9, 1.0), (14, 7.0), (16, 2.0), (20, 6.0), (25, 4.0)):
        rows.append(("a", f"2025-03-{day:02d} 12:00", v))
    m = meter_df(rows)
    agg = run(m, tariff_df([("a", "2025-03-15", "Kvällsplan 6 kW Villa")]), "month", ["top3_mean"])
    split = PR.clean(agg).collect()
    assert sorted((r.ord, r.v) for r in split) == [(0, pytest.approx(13 / 3)), (1, pytest.approx(4.0))]
    merged = PR.clean(agg, collapse_months=True).collect()
    assert len(merged) == 1 and merged[0].v == pytest.approx((7.0 + 6.0 + 5.0) / 3)
    direct = run(m, None, "month", ["top3_mean"], use_price=False).first().top3_mean_consumption
    assert merged[0].v == pytest.approx(direct)


def test_unit_among_its_own_twins_loses_no_neighbour(spark):
    # a household that adopts twice is a control at its earlier date; its twins have larger ids
    ti = d("2025-01-01")
    feats = ["f1", "f2"]
    controls = [(ti, c, 1.0, 2.0) for c in ["0", "1", "2", "3", "4", "5", "6", "7"]] + [(ti, "z0", 9.0, 9.0), (ti, "z1", 8.0, 3.0)]
    c = spark.createDataFrame(controls, "Ti date, control_id string, f1 double, f2 double")
    t = spark.createDataFrame([(ti, "0", 1.0, 2.0)], "Ti date, treated_id string, f1 double, f2 double")
    got = MT.knn_edges(t, c, feats, 5).orderBy("neighbor").collect()
    assert [(r.control_id, r.distance) for r in got] == [(str(i), 0.0) for i in range(1, 6)]


def _profiles(shape, n, seed):
    rng = np.random.default_rng(seed)
    if shape == "heavy tails":          # a few households dwarf the rest
        return rng.standard_normal((n, 1)) * rng.pareto(1.2, (n, 1)) * 50 + rng.standard_normal((n, 3))
    if shape == "tight clusters":       # nearly equal homes, far from each other
        return rng.integers(0, 4, (n, 1)) * 1000.0 + rng.standard_normal((n, 3)) * 0.01
    return np.cumsum(rng.standard_normal((n, 6)), axis=1)


def _knn_frames(spark, x, t):
    feats = [f"f{i}" for i in range(x.shape[1])]
    schema = ", ".join(f"{f} double" for f in feats)
    day = d("2025-01-01")
    controls = spark.createDataFrame([(day, f"c{i:05d}", *map(float, r)) for i, r in enumerate(x)], f"Ti date, control_id string, {schema}")
    treated = spark.createDataFrame([(day, f"t{i:03d}", *map(float, r)) for i, r in enumerate(t)], f"Ti date, treated_id string, {schema}")
    return treated, controls, feats


@pytest.mark.parametrize("shape", ["heavy tails", "tight clusters", "plain"])
def test_knn_on_uneven_profiles(spark, shape):
    x, t = _profiles(shape, 1500, 1), _profiles(shape, 40, 2)
    treated, controls, feats = _knn_frames(spark, x, t)
    mu, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    got = {}
    for r in MT.knn_edges(treated, controls, feats, 5).orderBy("neighbor").collect():
        got.setdefault(int(r.treated_id[1:]), []).append(int(r.control_id[1:]))
    for i, row in enumerate(t):
        dist = np.sqrt((((x - mu) / sd - (row - mu) / sd) ** 2).sum(axis=1))
        assert sorted(dist[got[i]]) == pytest.approx(sorted(dist)[:5], rel=1e-9), shape


@pytest.mark.parametrize("shape", ["heavy tails", "tight clusters"])
def test_candidates_do_not_follow_the_number_of_controls(spark, shape):
    looked = {}
    for n in (1000, 8000):
        treated, controls, feats = _knn_frames(spark, _profiles(shape, n, 1), _profiles(shape, 40, 2))
        stats = MT.month_stats(controls, feats)
        cells = MT.ControlCells(controls, stats, feats, 5, 32)
        units = MT.bounded_units(cells, MT.scaled_units(treated, stats, feats), feats, 5)
        looked[n] = cells.pairs(cells.near(units), units, feats).count() / 40
        sizes = [r["count"] for r in cells.controls.groupBy("node").count().collect()]
        assert max(sizes) <= 4 * 32 and len(sizes) >= n / 256
    assert looked[8000] < 8000 / 20 and looked[8000] < 4 * looked[1000], looked


def test_months_with_few_controls(spark):
    x = np.arange(12.0).reshape(4, 3)
    treated, controls, feats = _knn_frames(spark, x, x[:2] + 0.1)
    assert MT.knn_edges(treated, controls, feats, 5).count() == 8       # all four for both
    assert MT.knn_edges(treated, controls.limit(0), feats, 5).count() == 0
    assert MT.knn_edges(treated.limit(0), controls, feats, 5).count() == 0


def test_a_cell_passes_on_k_controls_per_unit(spark):
    # rows that leave a cell follow the units, not the pairs of units and controls
    x, t = _profiles("plain", 3000, 1), _profiles("plain", 40, 2)
    treated, controls, feats = _knn_frames(spark, x, t)
    stats = MT.month_stats(controls, feats)
    cells = MT.ControlCells(controls, stats, feats, 5, 512)
    units = MT.bounded_units(cells, MT.scaled_units(treated, stats, feats), feats, 5)
    near = cells.near(units)
    rows = cells.pairs(near, units, feats).collect()
    assert len(rows) == near.count() * 5
    for r in rows[::97]:
        c, u = x[int(r.control_id[1:])], t[int(r.treated_id[1:])]
        assert r.distance == pytest.approx(np.sqrt((((c - u) / x.std(axis=0, ddof=1)) ** 2).sum()), rel=1e-9)


def test_smallest_breaks_ties_by_place_and_puts_nan_last():
    rows, columns = MT._smallest(np.array([[2.0, 1.0, np.nan, 1.0, 1.0], [np.nan, np.nan, 3.0, np.nan, np.inf]]), 3)
    assert rows.tolist() == [0, 0, 0, 1, 1, 1] and columns.tolist() == [1, 3, 4, 2, 4, 0]
