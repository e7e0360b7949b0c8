"""Column expressions: they run inside the JVM and never leave the plan."""
