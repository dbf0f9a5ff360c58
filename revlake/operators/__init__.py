"""Aggregates, serving queries, descriptive tables, statistics, topics and evaluation."""
