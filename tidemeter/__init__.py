"""A Spark-native engine for metered usage and corpus preparation."""
