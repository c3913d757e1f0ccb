"""Structured Streaming jobs for newly landed items."""
