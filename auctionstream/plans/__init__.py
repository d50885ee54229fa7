"""Reusable plan shapes: range partitions, hot keys and cuts of long sequences."""
