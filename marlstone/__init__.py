"""marlstone: a PySpark-native analytics engine over DataFrames, Spark SQL and Structured Streaming."""
