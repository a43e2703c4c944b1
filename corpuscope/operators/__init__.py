"""Operators: ``DataFrame -> DataFrame`` functions without side effects."""
