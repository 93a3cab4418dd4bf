"""Registered queries of the correspondence operators and their SQL."""
