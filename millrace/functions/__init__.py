"""Column functions."""

from millrace.functions.exact import exact_sum

__all__ = ["exact_sum"]
