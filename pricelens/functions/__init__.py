"""Column functions: Column in, Column out, all native Spark expressions."""
