"""A Spark-native engine for hybrid retrieval and answer-quality analytics."""
