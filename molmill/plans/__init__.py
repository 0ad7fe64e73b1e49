"""Whole workloads, and the queries that run each operator on the test tables."""
