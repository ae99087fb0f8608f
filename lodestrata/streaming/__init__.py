"""Streaming of the repository-history engine."""
