"""Column functions: text in, columns out. All run inside the JVM."""
