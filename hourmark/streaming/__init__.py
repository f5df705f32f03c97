"""Structured Streaming forms of publishing and metering."""
