"""A Spark-native engine for line-addressed text: parse, index, search, quote and check."""
