"""Event log analytics on PySpark: ordered events, positional reads and an exact inverted index."""
