"""Whole jobs and the tables they start from."""
