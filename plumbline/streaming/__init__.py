"""Structured Streaming forms of the log's behaviours."""
