"""A PySpark engine for document privacy analytics."""
