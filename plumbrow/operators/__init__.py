"""The audit operators. Each takes DataFrames and returns DataFrames."""
