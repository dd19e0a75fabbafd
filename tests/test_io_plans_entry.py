import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from loadshape.operators import aggregate as A
from loadshape.plans.pipeline import run
from loadshape.plans.queries import QUERIES, meter_l
from loadshape.sources import files

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sinks_round_trip(spark, meter_df):
    m = meter_df([("a", "2025-01-08 08:00", 1.0), ("a", "2025-01-08 12:00", 3.0)])
    out = run(m, None, "month", ["sum", "top3_mean"])
    folder = tempfile.mkdtemp(prefix="loadshape-sink-")
    files.write_aggregate(out, os.path.join(folder, "agg"))
    back = files.scan_aggregate(spark, os.path.join(folder, "agg"))
    assert {r.price for r in back.collect()} == {"all", "high"}
    assert back.where("price = 'high'").first().sum_consumption == 4.0
    files.write_small_csv(out.select("price", "sum_consumption"), os.path.join(folder, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(folder, "csv")).count() == 2
    prof = files.dataset_profile(m).first()
    assert (prof.n_rows, prof.n_households, prof.n_days) == (2, 1, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_plans_have_no_python_udf_and_prune_columns(spark):
    for name in ("monthly_aggregate", "match_timeseries", "peak_rank_box", "event_study"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    plan = _plan(meter_l(spark, SF).select("aID"))
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_top3_plan_shape(spark):
    rows = meter_l(spark, SF)
    only_top3 = _plan(A.aggregate(rows, "month", ["top3_mean"], True))
    assert "WindowGroupLimit" in only_top3
    multi = _plan(A.aggregate(rows, "month", ["top3_mean", "variance", "mean", "sum"], True))
    assert multi.count("FileScan parquet") == 1                          # one scan of the readings
    assert len(re.findall(r"Exchange hashpartitioning", multi)) <= 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    from loadshape.plans.queries import QUERIES
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())
    assert df.columns[:4] == ["aID", "TIDPUNKT", "price", "tariff_active"]
    assert df.columns[-4:] == ["tariff_start", "tariff_plan", "total_consumption", "usage_group"]


def test_survey_scan_and_preview(spark, meter_df, tmp_path):
    p = tmp_path / "survey.csv"
    p.write_text("Respondent,Respondent_ID,Answer_created,Answer_completed,Vilket_kön,Id\n"
                 "anon,17,2025-02-01 10:00:00,2025-02-01 10:05:00,Kvinna,735999166200001042\n")
    r = files.scan_survey_csv(spark, str(p)).first()
    assert r.Respondent_ID == 17 and r.Id == "735999166200001042"
    m = meter_df([("b", "2025-01-08 08:00", 1.0), ("a", "2025-01-08 12:00", 3.0), ("a", "2025-01-08 09:00", 2.0)])
    head = files.preview(m, 2, "aID", "TIDPUNKT").collect()
    assert [(x.aID, x.FORBRUKNING_KWH) for x in head] == [("a", 2.0), ("a", 3.0)]


def test_scale_settings_sizes_partitions():
    from loadshape.session import scale_settings
    big = scale_settings(100 * 2**40, total_cores=8000)           # 100 TB on 1000 x 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 51200      # 12.5 TiB of partials / 256 MiB
    small = scale_settings(50 * 2**20, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16       # floor: two waves of cores
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 2**20)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_no_query_plans_nested_loop_cartesian_or_python(spark):
    # the queries with joins or one-row results (scripts/plan_audit.py checks all 67)
    names = ["tariff_join", "attach_tariff", "attach_usage_group", "usage_group", "adoption_share",
             "plan_cumulative", "peak_histogram", "risk_set", "lookback_window", "match_summary",
             "balance_summary", "monthly_aggregate", "event_study"]
    bad = []
    for name in names:
        plan = _plan(QUERIES[name](spark, SF))
        if re.search(r"BroadcastNestedLoopJoin|CartesianProduct|BatchEvalPython|ArrowEvalPython", plan):
            bad.append(name)
    assert bad == []
