"""Operators of a training-data pipeline; each query sits beside its operator."""
