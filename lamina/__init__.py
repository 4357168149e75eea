"""A Spark-native engine for layered, hierarchical content data."""
