"""Operators: DataFrame in, DataFrame out, keyed by the columns in ``by``."""
