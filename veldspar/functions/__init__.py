"""Column expressions and the few Arrow functions that Spark's built-ins cannot express."""
