"""Readers that give every source the same lenient schema."""
