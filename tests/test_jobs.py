import datetime as dt
import os
import random
import tempfile

from loadshape.jobs import aggregate_job, match_job


def test_end_to_end_jobs(spark):
    import pandas as pd
    rnd = random.Random(0)
    base = tempfile.mkdtemp(prefix="loadshape-jobs-")
    rows = []
    for h in range(12):
        for day in range(0, 450, 3):
            for hour in (3, 9, 18):
                t = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
                rows.append((f"73599916620000{h:02d}", t, t.date(), round(rnd.uniform(0, 5) + h * 0.1, 3)))
    pdf = pd.DataFrame(rows, columns=["aID", "TIDPUNKT", "TIDPUNKT_DAG", "FORBRUKNING_KWH"])
    pdf["TIDPUNKT"] = pdf["TIDPUNKT"].dt.tz_localize("UTC")
    pdf.to_parquet(os.path.join(base, "meter.parquet"))            # nanosecond UTC, as pandas writes
    with open(os.path.join(base, "tariff.csv"), "w") as f:
        f.write("Produktnamn,Startdatum,GS1-nr.\n")
        for h in (0, 1, 2):
            f.write(f"Kvällsplan 6 kW Villa,2025-0{2 + h}-01,73599916620000{h:02d}\n")
    agg = os.path.join(base, "monthly_agg")
    aggregate_job(spark, os.path.join(base, "meter.parquet"), os.path.join(base, "tariff.csv"), agg)
    out = os.path.join(base, "results")
    match_job(spark, agg, out)
    m = spark.read.parquet(os.path.join(out, "matching", "matches_ts.parquet"))
    assert m.count() == 3 * 5 and set(m.columns) >= {"id", "control_id", "treated_id", "adoption_month", "distance"}
    bal = spark.read.option("header", True).csv(os.path.join(out, "diagnostics", "balance_summary.csv"))
    assert sorted(r.covariate for r in bal.collect()) == ["peak_mean", "peak_sd", "peak_volatility"]
