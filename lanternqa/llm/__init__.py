"""Training-data pipeline operators, one module each, and their queries."""
