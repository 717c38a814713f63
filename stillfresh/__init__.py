"""Set-at-a-time build reuse, incremental tables and table evidence on Spark DataFrames."""
