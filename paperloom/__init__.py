"""A Spark-native analytics engine for business documents."""
