"""Change-review analytics on Spark: diffs, scopes, rule scans, verdicts and reports as DataFrames."""
