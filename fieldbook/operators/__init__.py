"""Operators of the contest model."""
