"""Windowed counts over events."""
