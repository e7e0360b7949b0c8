"""Structured Streaming jobs; each must equal its batch counterpart."""
