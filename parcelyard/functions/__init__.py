"""Column builders: pure expressions over Columns."""
