"""Column functions and small helpers, all JVM-side unless said otherwise."""
