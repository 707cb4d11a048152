"""Fixture views, the end-to-end search plan and the query catalogue."""
