"""Whole query plans: the climate pipeline and the registered queries."""
