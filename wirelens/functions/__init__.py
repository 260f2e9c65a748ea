"""Column-level building blocks; no Python runs per row in here."""
