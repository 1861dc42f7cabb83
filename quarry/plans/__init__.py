"""Whole plans over the operators, and the catalogue of queries."""
