"""PySpark-native analytics over append-only notice and award records."""
