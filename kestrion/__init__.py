"""A Spark-native hybrid retrieval and corpus-processing engine."""
