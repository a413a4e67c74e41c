"""Feature registry, planner and configured runs."""
