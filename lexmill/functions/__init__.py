"""Column functions; all of them built-in expressions that stay in the JVM."""
