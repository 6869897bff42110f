"""Operators on frames and files."""
