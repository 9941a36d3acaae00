"""larder: a PySpark-native engine for large tables of free text and recipe material."""
