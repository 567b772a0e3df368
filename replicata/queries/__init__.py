"""Registered queries: each has a Spark form and, where SQL can express it, an oracle."""
