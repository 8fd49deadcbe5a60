"""Reading, writing and adapting tables."""
