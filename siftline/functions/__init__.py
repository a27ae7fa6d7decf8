"""Column expressions: every function here maps Columns to a Column with
built-in Spark SQL functions only."""
