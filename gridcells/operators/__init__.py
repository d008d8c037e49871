"""Grid operators: pure functions from DataFrames/GridTables to DataFrames."""
