"""Scalar and aggregate functions with the reference's rules, as Column expressions (Python only where said)."""
