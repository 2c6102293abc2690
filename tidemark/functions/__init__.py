"""Column expressions: DataFrame-free building blocks evaluated inside the JVM."""
