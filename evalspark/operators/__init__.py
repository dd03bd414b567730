"""DataFrame operators: DataFrames in, DataFrames out, nothing executed except topic fits."""
