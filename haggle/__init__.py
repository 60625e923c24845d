"""haggle: a Spark-native engine for collecting, comparing and storing shopping listings."""
