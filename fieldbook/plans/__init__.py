"""Plans of the contest model."""
