"""Event-listing analytics as Spark DataFrame operations."""
