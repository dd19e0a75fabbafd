"""Month vectors, weighted balance and queries through the file readers."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loadshape.operators import balance as BL
from loadshape.operators import profiles as PR
from loadshape.plans.queries import QUERIES
from loadshape.sources.files import scan_aggregate, write_aggregate

COLUMNS = "aID string, TIDPUNKT date, tariff_start date, tariff_active int, price string, top3_mean_consumption double"


def months_before(day, n):
    y, m = divmod(day.year * 12 + day.month - 1 - n, 12)
    return dt.date(y, m + 1, min(day.day, 28))


def monthly_rows(seed, households=40):
    rng = random.Random(seed)
    rows = []
    for h in range(households):
        start = None if h % 3 == 0 else dt.date(2023, rng.randrange(1, 13), rng.choice([1, 15]))
        for k in range(36):
            month = dt.date(2021 + k // 12, k % 12 + 1, 1)
            if rng.random() < 0.08:
                continue
            halves = (0, 1) if start and start.day == 15 and (start.year, start.month) == (month.year, month.month) else (0,)
            for active in halves:
                v = None if rng.random() < 0.1 else round(rng.lognormvariate(1, 1), 3)
                rows.append((f"h{h}", month, start, active, "all", v))
    rows += [(None, dt.date(2022, 1, 1), dt.date(2023, 1, 1), 0, "all", 1.0), ("h1", dt.date(2022, 1, 1), dt.date(2023, 1, 1), 0, "high", 9.0)]
    return rows


def plain_window(rows, household, ti, lookback):
    own = [r for r in rows if r[0] == household and r[4] == "all" and months_before(ti, lookback) <= r[1] < ti]
    return [r[5] for r in sorted(own, key=lambda r: (r[1], r[3]))]


@pytest.mark.parametrize("lookback", [1, 6, 12])
def test_profiles_against_plain_windows(spark, lookback):
    rows = monthly_rows(lookback)
    data = spark.createDataFrame(rows, COLUMNS).repartition(5)
    adopted = {(r[0], r[2]) for r in rows if r[0] and r[2] and r[4] == "all"}
    want = {(h, ti): w for h, ti in adopted if len(w := plain_window(rows, h, ti, lookback)) >= lookback}
    series = PR.build_profiles(data, lookback_months=lookback)
    assert {(r.id, r.adoption_month): [r[f"peak_{i + 1}"] for i in range(lookback)] for r in series.collect()} == \
        {key: w[:lookback] for key, w in want.items()}
    got = {(r.id, r.adoption_month): r for r in PR.build_profiles(data, lookback_months=lookback, feature_mode="summary").collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        known = [v for v in w if v is not None]
        steps = [abs(b - a) for a, b in zip(w, w[1:]) if a is not None and b is not None]
        assert got[key].peak_mean == (pytest.approx(statistics.fmean(known)) if known else None)
        assert got[key].peak_sd == (pytest.approx(statistics.stdev(known)) if len(known) > 1 else None)
        assert got[key].peak_volatility == (pytest.approx(statistics.fmean(steps)) if steps else None)


def test_profiles_shuffle_once_and_empty(spark):
    data = spark.createDataFrame(monthly_rows(2), COLUMNS)
    plan = PR.build_profiles(data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    assert PR.build_profiles(data.limit(0)).count() == 0


def matched(spark, n_edges, seed=3):
    """One control takes a third of all edges; large values, small spread."""
    rng = random.Random(seed)
    day = dt.date(2023, 1, 1)
    profiles = [(f"u{i}", 1e6 + rng.random(), None if i % 7 == 0 else rng.random(), day) for i in range(60)]
    by_id = {p[0]: p for p in profiles}
    edges = []
    for i in range(n_edges):
        control = "u40" if i % 3 == 0 else f"u{rng.randrange(30, 70)}"      # u60 and on have no profile
        edges.append((f"u{rng.randrange(0, 30)}", control, day, *(by_id[control][1:3] if control in by_id else (5.0, None))))
    return (profiles, edges, spark.createDataFrame(profiles, "id string, a double, b double, adoption_month date"),
            spark.createDataFrame(edges, "treated_id string, control_id string, adoption_month date, a double, b double").repartition(4))


@pytest.mark.parametrize("mode", ["own_adoption", "at_match"])
def test_weighted_balance_against_expanded_edges(spark, mode):
    profiles, edges, p, m = matched(spark, 400)
    by_id = {x[0]: x for x in profiles}
    got = {r.covariate: r for r in BL.balance_table(p, m, mode).collect()}
    for place, name in ((1, "a"), (2, "b")):
        treated = [by_id[t][place] for t in {e[0] for e in edges} if by_id[t][place] is not None]
        if mode == "at_match":
            control = [e[2 + place] for e in edges if e[2 + place] is not None]
        else:
            control = [by_id[e[1]][place] for e in edges if e[1] in by_id and by_id[e[1]][place] is not None]
        mt, mc = statistics.fmean(treated), statistics.fmean(control)
        smd = (mt - mc) / ((statistics.variance(treated) + statistics.variance(control)) / 2) ** 0.5
        assert got[name].treated_mean == pytest.approx(mt, rel=1e-12) and got[name].control_mean == pytest.approx(mc, rel=1e-12)
        assert got[name].SMD == pytest.approx(smd, rel=1e-6)


def test_balance_without_edges_keeps_its_covariates(spark):
    _, _, p, m = matched(spark, 5)
    rows = BL.balance_table(p, m.limit(0), check_nonempty=False).collect()
    assert {(r.covariate, r.treated_mean, r.SMD) for r in rows} == {("a", None, None), ("b", None, None)}


def test_one_price_is_one_folder(spark, tmp_path):
    data = spark.createDataFrame([("a", p, float(i)) for i, p in enumerate(["all", "high", "low"])], "aID string, price string, v double")
    write_aggregate(data, f"{tmp_path}/agg")
    one = scan_aggregate(spark, f"{tmp_path}/agg").where(F.col("price") == "all")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(price" in plan
    rows = one.withColumn("file", F.input_file_name()).collect()
    assert [r.v for r in rows] == [0.0] and "/price=all/" in rows[0].file


def test_readers_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    meter = QUERIES["scan_meter"](spark, sf)
    assert any("/meter-" in f for f in meter.inputFiles())
    tariff = QUERIES["scan_tariff"](spark, sf)
    assert any("/tariff-" in f for f in tariff.inputFiles())
