"""Operators on page tables."""
