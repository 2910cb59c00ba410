"""Keyed stateful work on streams."""
