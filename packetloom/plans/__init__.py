"""Whole jobs assembled from the operators, and the registered queries."""
