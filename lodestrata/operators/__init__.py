"""Operators of the repository-history engine."""
