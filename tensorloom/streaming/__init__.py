"""Unbounded tensors."""
