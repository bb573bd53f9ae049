"""Streaming of the contest model."""
