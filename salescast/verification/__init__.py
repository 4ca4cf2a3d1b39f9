"""Registered queries over the test tables, and the same results in SQL."""
