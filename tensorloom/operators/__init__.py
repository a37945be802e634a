"""Operators on tensors as DataFrames."""
