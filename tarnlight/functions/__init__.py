"""Scalar expressions: base codes, distances, schedules, waves and plot geometry."""
