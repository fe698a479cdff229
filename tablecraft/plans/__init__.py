"""Flows over several operators."""
