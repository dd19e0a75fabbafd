"""Sources and sinks: meter Parquet, tariff/survey CSV, aggregate Parquet,
balance CSV, and the stand-in views over the driver's test tables."""
