"""A Spark-native graph analytics engine."""
