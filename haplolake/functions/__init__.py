"""Column functions over sequences, qualities and names; all stay inside the JVM."""
