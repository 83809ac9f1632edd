"""Registered queries: inputs derived from the driver tables, the Spark queries, and their SQL oracles."""
