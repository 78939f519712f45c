"""Training-data operators: the ten corpus operations and their queries."""
