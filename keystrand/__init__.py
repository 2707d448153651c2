"""Keyed state, change logs and measurement analytics on Spark."""
