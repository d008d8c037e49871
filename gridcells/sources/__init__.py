"""Sources (open, combine, flatten, densify, guard) and sinks (CSV, JSON, Parquet)."""
