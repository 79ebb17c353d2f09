"""Reading and writing, and graphs derived from tables."""
