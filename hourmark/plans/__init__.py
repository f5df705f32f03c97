"""Whole jobs: requests over the published tree, publishing, and the catalogue of what is published."""
