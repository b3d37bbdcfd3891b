"""Operators: DataFrame to DataFrame, lazily."""
