"""Stateful operators on Structured Streaming."""
