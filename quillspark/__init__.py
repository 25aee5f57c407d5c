"""A PySpark-native engine for preparing document collections for retrieval."""
