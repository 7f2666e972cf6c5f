"""countercheck: data validation and reconciliation as Spark jobs.

Operators are plain functions from DataFrames and options to DataFrames.
Nothing runs until a result is consumed, unless a docstring says otherwise.
"""
