"""veldspar: a Spark-first engine for text privacy, identity resolution and corpus preparation."""
