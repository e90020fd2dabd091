"""Structured Streaming over event envelopes."""
