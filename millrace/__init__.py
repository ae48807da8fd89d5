"""A PySpark-native analytics engine for commerce events."""
