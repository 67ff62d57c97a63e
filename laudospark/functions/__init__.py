"""Column -> Column building blocks; everything stays inside the JVM."""
