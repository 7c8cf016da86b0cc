"""Structured Streaming: adaptive models whose state is kept for each key."""
