"""Column functions: Column in, Column out, evaluated inside Spark's generated code."""
