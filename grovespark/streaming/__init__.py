"""Counts kept up to date over arriving data."""
