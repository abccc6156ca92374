"""DataFrame operators: each takes DataFrames and settings and returns a DataFrame, without an action."""
