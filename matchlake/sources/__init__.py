"""Sources of the match analytics engine."""
