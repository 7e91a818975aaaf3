"""Scalar functions: text forms, similarity, durations."""
