"""Whole computations over graphs, time series, vectors and texts."""
