"""Training-data pipeline operators and their queries. Nothing else in the library imports this."""
