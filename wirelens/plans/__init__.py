"""How operators are put together: shared inputs, rule registry, full analysis."""
