"""Streaming extension of the keyed state."""
