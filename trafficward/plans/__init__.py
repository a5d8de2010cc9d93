"""Whole batch jobs assembled from the operators."""
