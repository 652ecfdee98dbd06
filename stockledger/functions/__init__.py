"""Column expressions shared by the products; all of them stay in the JVM."""
