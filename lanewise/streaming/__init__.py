"""Structured Streaming counterparts of the per-frame operators."""
