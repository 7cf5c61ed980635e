"""Streaming forms of the daily aggregation and of the signal state."""
