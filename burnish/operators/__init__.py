"""Table-level jobs: every function takes DataFrames and returns a DataFrame."""
