"""Column expressions. All are built from JVM functions."""
