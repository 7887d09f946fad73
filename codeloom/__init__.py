"""A PySpark-native engine for code-model data and corpus preparation."""
