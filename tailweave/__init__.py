"""Extreme-dependence analytics on Spark: ranks, tail dependence, lagged graphs, chains, puzzles and verification."""
