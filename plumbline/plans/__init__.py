"""Registered queries: operators applied to views of the supplied tables, with their SQL."""
