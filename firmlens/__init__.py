"""firmlens: company and web intelligence as Spark DataFrame operations."""
