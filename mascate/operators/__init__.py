"""Report operators: DataFrames and parameters in, lazy DataFrames out."""
