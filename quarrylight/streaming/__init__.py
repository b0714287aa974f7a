"""Structured Streaming over source events."""
