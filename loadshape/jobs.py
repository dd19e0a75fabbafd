"""Batch jobs for spark-submit: the study's two end-to-end steps.

    zip -r loadshape.zip loadshape
    spark-submit --py-files loadshape.zip loadshape/jobs.py aggregate --meter M --tariff T --out OUT
    spark-submit --py-files loadshape.zip loadshape/jobs.py match --agg OUT --out RESULTS

``aggregate`` writes the monthly household aggregate (partitioned by price);
``match`` reads it back and writes both match sets (Parquet) and both
balance tables (one small CSV each), for the time-series and the summary
feature modes.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from loadshape.operators.balance import balance_table
from loadshape.operators.matching import risk_set_matching
from loadshape.operators.profiles import build_profiles
from loadshape.plans.pipeline import run
from loadshape.session import apply_scale_settings, ensure_checkpoint_dir
from loadshape.sources.files import (scan_aggregate, scan_holidays_csv, scan_meter, scan_tariff_csv,
                                     write_parquet, write_small_csv)


def aggregate_job(spark: SparkSession, meter_path: str, tariff_path: str | None, out: str,
                  freq: str = "month", methods: Sequence[str] = ("top3_mean", "variance", "mean"),
                  usage: Sequence[float] | None = (0.25, 0.75), local_tz: str | None = None,
                  holidays_path: str | None = None, country: str | None = None) -> None:
    meter = scan_meter(spark, meter_path, local_tz)
    tariff = scan_tariff_csv(spark, tariff_path) if tariff_path else None
    holidays = scan_holidays_csv(spark, holidays_path) if holidays_path else country
    run(meter, tariff, freq, list(methods), True, list(usage) if usage else None, output_path=out,
        holidays=holidays)


def match_job(spark: SparkSession, agg_path: str, out: str, lookback_months: int = 12,
              k_neighbors: int = 5, price_filter: str = "all") -> None:
    ensure_checkpoint_dir(spark)
    agg = scan_aggregate(spark, agg_path).where(f"price = '{price_filter}'")
    for mode, tag in (("time_series", "ts"), ("summary", "summary")):
        matches = risk_set_matching(agg, lookback_months=lookback_months, k_neighbors=k_neighbors,
                                    price_filter=price_filter, feature_mode=mode)
        write_parquet(matches, os.path.join(out, "matching", f"matches_{tag}.parquet"))
        matches = scan_aggregate(spark, os.path.join(out, "matching", f"matches_{tag}.parquet"))
        profiles = build_profiles(agg, lookback_months=lookback_months, price_filter=price_filter,
                                  feature_mode=mode)
        write_small_csv(balance_table(profiles, matches), os.path.join(out, "diagnostics", f"balance_{tag}.csv"))


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loadshape.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("aggregate")
    a.add_argument("--meter", required=True)
    a.add_argument("--tariff")
    a.add_argument("--out", required=True)
    a.add_argument("--freq", default="month")
    a.add_argument("--methods", default="top3_mean,variance,mean")
    a.add_argument("--usage", default="0.25,0.75", help="two quantiles, or 'none'")
    a.add_argument("--local-tz")
    a.add_argument("--holidays", help="CSV date,name; high price never applies on these dates")
    a.add_argument("--country", help="country code of a computed holiday calendar, such as SE, where no CSV is given")
    a.add_argument("--input-bytes", type=int, help="size of the meter input; sizes partitions")
    a.add_argument("--cores", type=int, help="total executor cores of the cluster")
    m = sub.add_parser("match")
    m.add_argument("--agg", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--lookback", type=int, default=12)
    m.add_argument("--k", type=int, default=5)
    m.add_argument("--price", default="all")
    args = p.parse_args(argv)
    spark = (SparkSession.builder.appName(f"loadshape-{args.cmd}")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if args.cmd == "aggregate":
        if args.input_bytes and args.cores:
            apply_scale_settings(spark, args.input_bytes, args.cores)
        usage = None if args.usage == "none" else [float(x) for x in args.usage.split(",")]
        aggregate_job(spark, args.meter, args.tariff, args.out, args.freq, args.methods.split(","), usage,
                      args.local_tz, args.holidays, args.country)
    else:
        match_job(spark, args.agg, args.out, args.lookback, args.k, args.price)


if __name__ == "__main__":
    main()
