"""Operators for preparing large text corpora, on Spark.

Every operator takes and returns DataFrames.  A null text counts as empty, rows
are never dropped to escape skew, and columns an operator does not use are
ignored, whatever their names.
"""
