"""Stores, logs and result files."""
