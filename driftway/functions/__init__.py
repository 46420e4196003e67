"""Column-level building blocks; all stay inside the JVM."""
