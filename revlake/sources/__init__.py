"""Readers and canonical frames."""
