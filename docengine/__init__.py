"""A PySpark-native engine for document retrieval analytics."""
