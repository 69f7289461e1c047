"""Composed analyses.  Each takes ``Tables`` (or DataFrames) and parameters and
returns a DataFrame; ``catalogue`` lists them by name."""
