"""Composed plans: fusion layer, iterative search, regression fusion."""
