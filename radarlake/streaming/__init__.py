"""Streams of page requests (an extension over Structured Streaming)."""
