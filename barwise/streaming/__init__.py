"""Bars and levels from streams."""
