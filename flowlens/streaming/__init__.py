"""Structured Streaming forms of the metrics and of event matching."""
