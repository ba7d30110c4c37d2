"""Column functions: DataFrame-free expressions, all evaluated inside the JVM."""
