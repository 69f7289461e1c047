from __future__ import annotations


def rows(df, *order):
    """Collected rows as plain tuples, sorted for comparison."""
    out = [tuple(r) for r in df.collect()]
    return out if order == (False,) else sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def final_plan(df) -> str:
    """Physical plan after adaptive execution ran it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
