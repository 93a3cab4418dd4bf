"""Training-data operators: dedup, scans, mixing, sharding, chat and quality.

Ten operators that turn raw text tables into a training corpus.  Nothing else
in the library imports this subpackage; ``queries.py`` holds the registered
queries and their SQL.
"""
