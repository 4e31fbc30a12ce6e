"""Functions of the match analytics engine."""
