"""Streaming form of the transition operator (F1/E1 on arriving events)."""
