"""A PySpark engine for document knowledge graphs."""
