"""Whole jobs, chained from the operators."""
