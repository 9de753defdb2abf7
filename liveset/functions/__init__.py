"""Column functions; all but two stay on the JVM."""
