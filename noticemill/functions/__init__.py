"""Column expressions; all JVM-side, no Python UDFs."""
