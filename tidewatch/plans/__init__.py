"""Registered queries: each pairs a Spark job with the SQL text that must give the same rows."""
