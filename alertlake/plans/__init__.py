"""Whole jobs made of operators, and the registered queries."""
