"""Registered queries: operators wired to the test tables, each with its SQL."""
