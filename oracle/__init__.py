"""Independent SQL for the same results, for comparison only."""
