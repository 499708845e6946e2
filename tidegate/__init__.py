"""A Spark-native analytics engine for a small MySQL/SQLite-flavoured SQL dialect."""
