"""Structured Streaming forms of the token report and the metric roll-up."""
