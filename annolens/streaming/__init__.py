"""Keyed stateful operators on streams of frames."""
