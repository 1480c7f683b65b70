"""Security-log analytics on Spark DataFrames: parsing, enrichment, detection, risk, search and streaming."""
