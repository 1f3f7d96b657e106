"""Whole plans: the fusion engine and the registered queries."""
