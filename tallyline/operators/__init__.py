"""Operators: DataFrame in, DataFrame or small document out."""
