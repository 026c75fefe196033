"""The trace operators on Structured Streaming."""
