"""The query register."""
