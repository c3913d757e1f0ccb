"""Relational operators over items, threads, tokens, and features."""
