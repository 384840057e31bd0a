"""PySpark-native analytics over multi-entity tracking data."""
