"""Training-data pipeline operators: one module for each operator, queries in ``queries``."""
