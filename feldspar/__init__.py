"""A Spark-native engine for grounded knowledge graphs."""
