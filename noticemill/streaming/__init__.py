"""The same jobs, run incrementally with Structured Streaming."""
