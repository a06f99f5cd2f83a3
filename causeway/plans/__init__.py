"""Whole plans: the test views, the registered queries and end-to-end runs."""
