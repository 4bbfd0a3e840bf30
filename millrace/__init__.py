"""Analytics on PySpark DataFrames."""
