"""Training-data operators: ten dealt operators and their queries."""
