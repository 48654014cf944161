"""Whole query plans composed from operators, and the registered queries over the test tables."""
