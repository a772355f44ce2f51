"""Rules as columns."""
