"""Operators: DataFrame -> DataFrame functions, grouped as in the blueprint."""
