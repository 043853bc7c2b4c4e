"""Training-data operators: one module per operator, its registered query beside it, the list of queries in ``catalog``."""
