"""parley: a PySpark-native text-analytics engine for conversation logs."""
