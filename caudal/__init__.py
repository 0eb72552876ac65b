"""caudal: a PySpark-native engine for procurement-cycle analytics and training-data preparation."""
