"""Structured Streaming: keyed masking state and traffic windows."""
