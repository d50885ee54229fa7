"""Scalar and aggregate column functions."""
