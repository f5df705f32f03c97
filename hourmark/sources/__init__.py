"""Readers of raw readings, station files and the published tree."""
