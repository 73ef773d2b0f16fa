"""Leakage-controlled evaluation and corpus preparation as Spark DataFrame operators."""
