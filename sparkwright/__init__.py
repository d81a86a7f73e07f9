"""sparkwright: a PySpark-native analytics engine."""
