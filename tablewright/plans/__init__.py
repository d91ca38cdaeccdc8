"""Composite jobs that chain several operators."""
