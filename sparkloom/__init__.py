"""A Spark-first engine for code, text and change analytics."""
