"""Part of tarnlight."""
