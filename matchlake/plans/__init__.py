"""Plans of the match analytics engine."""
