"""A Spark-native engine for daily market bars."""
