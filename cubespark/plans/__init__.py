"""Cubes made from the driver's tables, the registered queries on them, and SQL that says the same."""
