"""Operators on networks and tables: validation, percolation, candidates, ranking, statistics, selection."""
