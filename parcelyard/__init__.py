"""PySpark-native analytics for property listings and other dated records."""
