"""Streaming of the match analytics engine."""
