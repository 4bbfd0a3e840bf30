"""Building blocks that take and return DataFrames."""

from millrace.operators.totals import group_totals

__all__ = ["group_totals"]
