"""Exactly-once transaction stream analytics on PySpark."""
