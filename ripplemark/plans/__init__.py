"""Queries and whole-job plans built from the operators."""
