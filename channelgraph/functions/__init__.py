"""Column builders: scalar rules evaluated inside Spark expressions."""
