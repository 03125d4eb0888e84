"""DataFrame operators that Spark has no single call for, or that need a checked choice."""
