from slotwise.operators import aggregates, joins, quantiles, ranges, reshape, series, shares

__all__ = ["aggregates", "joins", "quantiles", "ranges", "reshape", "series", "shares"]
