"""Operators for training data. Nothing outside this package imports it; __spark_entry__ adds its queries if it is there."""
