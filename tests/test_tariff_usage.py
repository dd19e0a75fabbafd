import pandas as pd
import pytest
from pyspark.sql import functions as F

from study_values import d, ts
from loadshape.functions.stats import exact_quantiles
from loadshape.operators.tariff import dedup_tariff, join_tariff, normalize_tariff, tariff_info
from loadshape.operators.usage import usage_from_totals
from loadshape.plans.pipeline import run


def test_tariff_dedup_flags_and_mid_month(meter_df, tariff_df):
    m = meter_df([("a", "2025-03-14 23:00", 1.0), ("a", "2025-03-15 00:00", 2.0),
                  ("b", "2025-03-15 00:00", 3.0), ("c", "2025-03-15 00:00", 4.0)])
    t = tariff_df([("a", "2025-04-01", "Kvällsplan 14 kW Villa"),
                   ("a", "2025-03-15", "Kvällsplan 6 kW Villa"),   # earlier row wins
                   ("b", None, "x")])
    assert {r.aID: r.tariff_start for r in dedup_tariff(t).collect()} == {"a": d("2025-03-15"), "b": None}
    rows = {(r.aID, r.TIDPUNKT): r for r in join_tariff(m, t).collect()}
    assert rows[("a", ts("2025-03-14 23:00"))].tariff_active == 0
    assert rows[("a", ts("2025-03-15 00:00"))].tariff_active == 1
    assert rows[("a", ts("2025-03-15 00:00"))].has_tariff == 1
    assert rows[("b", ts("2025-03-15 00:00"))].has_tariff == 0
    assert rows[("c", ts("2025-03-15 00:00"))].tariff_active == 0
    # mid-month adoption splits the household-month into two rows
    out = run(m, t, "month", ["sum"], use_price=False).where("aID = 'a'").collect()
    assert sorted((r.tariff_active, r.sum_consumption) for r in out) == [(0, 1.0), (1, 2.0)]
    assert {r.tariff_plan for r in out} == {"6 kW Villa"}


def test_no_tariff_table_means_inactive(meter_df):
    m = meter_df([("a", "2025-03-14 23:00", 1.0)])
    r = run(m, None, "month", ["sum"]).first()
    assert r.tariff_active == 0 and "tariff_start" not in r.asDict()


def test_plan_token(tariff_df):
    t = tariff_df([("a", "2025-01-01", "Kvällsplan 6 kW Villa"),
                   ("b", "2025-01-01", "Kvällsplan 20kW Normal säkring"),
                   ("c", "2025-01-01", "Fast pris lägenhet")])
    got = {r.aID: r.tariff_plan for r in tariff_info(t).collect()}
    assert got == {"a": "6 kW Villa", "b": "20kW Normal", "c": None}


def test_raw_tariff_keeps_string_ids(spark, tmp_path):
    from loadshape.sources.files import scan_tariff_csv
    p = tmp_path / "tariff.csv"
    p.write_text("Produktnamn,Startdatum,GS1-nr.\nKvällsplan 6 kW Villa,2025-04-01,735999166200001042\n")
    t = normalize_tariff(scan_tariff_csv(spark, str(p))).first()
    assert t.aID == "735999166200001042" and t.tariff_start == d("2025-04-01")


def _totals(spark, values):
    return spark.createDataFrame([(f"h{i}", float(v)) for i, v in enumerate(values)],
                                 "aID string, total_consumption double")


def test_usage_bins_right_closed(spark):
    # quantiles of 1..5 at 0.25/0.75 are exactly 2 and 4: totals on a threshold go low/medium
    groups = {r.aID: r.usage_group for r in usage_from_totals(_totals(spark, [1, 2, 3, 4, 5])).collect()}
    assert groups == {"h0": "low", "h1": "low", "h2": "medium", "h3": "medium", "h4": "high"}


def test_usage_equal_totals_two_groups(spark):
    groups = {r.usage_group for r in usage_from_totals(_totals(spark, [7, 7, 7, 7])).collect()}
    assert groups == {"low"}
    groups = {r.aID: r.usage_group for r in usage_from_totals(_totals(spark, [1, 5, 5, 5, 9]), [0.4, 0.6]).collect()}
    assert groups == {"h0": "low", "h1": "low", "h2": "low", "h3": "low", "h4": "high"}


@pytest.mark.parametrize("parts,single", [(1, None), (3, None), (7, None), (3, 1_000_000)])
def test_exact_quantiles_match_pandas(spark, parts, single):
    import random
    rnd = random.Random(parts)
    rows = [(g, rnd.choice([None, round(rnd.gauss(10, 4), 3)]) if rnd.random() < 0.05 else round(rnd.gauss(10, 4), 3))
            for g in ("a", "b", "c") for _ in range(rnd.randint(1, 300))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q_index): r.quantile for r in exact_quantiles(df, "v", probs, by=["g"], partitions=parts,
                                                                    single_task_max=single).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    for g, grp in pdf.groupby("g"):
        for i, p in enumerate(probs):
            assert got[(g, i)] == pytest.approx(grp["v"].quantile(p), rel=1e-12, abs=1e-12)
    glob = {r.q_index: r.quantile for r in exact_quantiles(df, "v", probs, partitions=parts,
                                                                single_task_max=single).collect()}
    for i, p in enumerate(probs):
        assert glob[i] == pytest.approx(pdf["v"].quantile(p), rel=1e-12, abs=1e-12)


def test_grouped_quantiles_split_hot_groups(spark):
    import random
    from loadshape.functions.stats import grouped_quantiles
    rnd = random.Random(4)
    rows = [("hot", round(rnd.gauss(0, 1), 4)) for _ in range(400)] + \
           [(f"g{i % 9}", round(rnd.gauss(5, 2), 4)) for i in range(200)] + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.5, 0.9]
    split = {r.g: (r._q0, r._q1) for r in grouped_quantiles(df, ["g"], "v", probs, single_task_max=50).collect()}
    plain = {r.g: (r._q0, r._q1) for r in grouped_quantiles(df, ["g"], "v", probs).collect()}
    assert split.keys() == plain.keys() and len(split) == 11
    for k in split:
        assert split[k] == pytest.approx(plain[k], rel=1e-12)


def test_exact_quantiles_many_partitions_vs_numpy(spark):
    import numpy as np
    from pyspark.sql import functions as F
    df = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("g"),
                                     (F.rand(7) * 1000).alias("v"))
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = {(r.g, r.q_index): r.quantile for r in
           exact_quantiles(df, "v", probs, by=["g"], partitions=64, single_task_max=None).collect()}
    pdf = df.toPandas()
    for g, grp in pdf.groupby("g"):
        want = np.quantile(grp["v"].to_numpy(), probs)
        for i, w in enumerate(want):
            assert got[(g, i)] == pytest.approx(w, rel=1e-12)


def test_object_api_matches_functions(meter_df, tariff_df):
    from loadshape.plans.pipeline import MeterAggregator
    m = meter_df([("a", "2025-01-08 08:00", 1.0), ("a", "2025-01-09 12:00", 3.0), ("b", "2025-01-08 09:00", 2.0)])
    t = tariff_df([("a", "2025-01-09", "Kvällsplan 6 kW Villa")])
    agg = MeterAggregator(m, t)
    a = sorted(tuple(r) for r in agg.run("month", ["sum", "top3_mean"], True, [0.25, 0.75]).collect())
    b = sorted(tuple(r) for r in run(m, t, "month", ["sum", "top3_mean"], True, [0.25, 0.75]).collect())
    assert a == b
    rows = agg.get_data().collect()
    assert {(r.aID, r.tariff_active) for r in rows} == {("a", 0), ("a", 1), ("b", 0)}
