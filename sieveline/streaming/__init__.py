"""Scoring of rows that arrive over time."""
