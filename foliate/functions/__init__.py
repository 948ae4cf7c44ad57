"""Column to Column functions; all stay in the JVM unless they say otherwise."""
