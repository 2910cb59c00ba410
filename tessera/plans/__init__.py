"""Composed plans and views."""
