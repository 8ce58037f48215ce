"""Live views with Structured Streaming."""
