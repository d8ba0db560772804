"""lexigrid: a Spark-native fact index and documentation analytics engine."""
