"""Operators of the match analytics engine."""
