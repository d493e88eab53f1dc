"""Structured Streaming counterparts of the run monitor."""
