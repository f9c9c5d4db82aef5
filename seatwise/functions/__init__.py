"""Column expressions (pure pyspark.sql.functions, JVM side)."""
