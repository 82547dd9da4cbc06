"""A PySpark-native engine for media analytics and text-corpus preparation."""
