"""A PySpark engine for periodic hopping networks and the data work around them."""
