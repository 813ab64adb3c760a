"""lodestore: a Spark-native engine for per-user vector memory and its analytics."""
