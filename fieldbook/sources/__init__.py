"""Sources of the contest model."""
