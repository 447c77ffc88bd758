"""Column expressions: everything here is built-in Spark SQL, no UDFs."""
