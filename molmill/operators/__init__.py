"""Filters, joins, aggregates, windows, similarity, graph and voxel jobs."""
